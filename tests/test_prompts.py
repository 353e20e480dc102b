from pyspark.sql import functions as F

from ragloom.functions import prompts as P


def test_prompt_functions(spark):
    row = spark.range(1).select(
        P.is_summary_query(F.lit("この章を要約して")).alias("summary"),
        P.looks_like_refusal(F.lit("わかりません。")).alias("refusal"),
        P.looks_like_refusal(F.lit("わかりませんが、次の条文が関係します。詳しくは以下。")).alias("no_refusal"),
        P.fast_intent(F.lit("hi")).alias("hi"),
        P.fast_intent(F.lit("第3条は")).alias("article"),
        P.fast_intent(F.lit("契約を比較して下さい")).alias("open"),
        P.parse_intent(F.lit("INTENT: Compare\nTOPIC: none\nsources: a, b,\nintent: summary")).alias("intent"),
        P.parse_numbered_list(F.lit("here:\n1. \"one\"\n- two\nskip\n・三")).alias("items"),
        P.query_variants(F.lit("q"), F.array(F.lit(" a "), F.lit("q"), F.lit(""), F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("variants"),
        P.chat_prompt(F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("text")))).alias("chat"),
        P.cut_at_stop(F.lit("abc<|im_end|>d<end_of_turn>")).alias("cut"),
        P.cut_at_stop(F.lit("abc")).alias("uncut"),
        P.middle_truncate(F.sequence(F.lit(1), F.lit(50)), 104, 20).alias("whole"),  # a budget is 64 at least
        P.middle_truncate(F.sequence(F.lit(1), F.lit(500)), 500, 36).alias("short"),
        P.middle_truncate(F.sequence(F.lit(1), F.lit(500)), 300, 36).alias("tail"),
        P.compress(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(v).alias("score")) for t, v in (("a", 0.1), ("b", 0.9), ("c", 0.0), ("d", 0.15), ("e", 0.05))])).alias("kept"),
        P.enrich(F.lit("(cap)\nbody"), F.array(F.lit("z"), F.lit("y"))).alias("inside"),
        P.enrich(F.lit("body"), F.array(F.lit("z"))).alias("front"),
        P.risk_findings(F.lit("Unlimited liability applies")).alias("risk"),
    ).collect()[0]
    assert row["summary"] and row["refusal"] and not row["no_refusal"]
    assert (row["hi"], row["article"], row["open"]) == ("smalltalk", "lookup", None)
    assert tuple(row["intent"]) == ("summary", None, ["a", "b"]) and row["items"] == ["one", "two", "三"]
    assert row["variants"] == ["q", "a", "b"] and row["chat"] == "<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\n"
    assert (row["cut"], row["uncut"]) == ("abc", "abc") and row["whole"] == [*range(1, 51)]
    assert row["short"] == [*range(1, 97), *range(197, 501)] and row["tail"] == [*range(301, 501)]
    assert row["kept"] == "a b d" and row["inside"] == "(cap ｜ シナリオ: y, z)\nbody" and row["front"] == "(z)\nbody"
    assert tuple(row["risk"][0]) == ("high", "liability")


def test_context_blocks_are_in_rank_order(spark):
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id long, rank int, text string")
    assert P.context_block(hits).collect()[0]["context"] == "<source id=1>a</source>\n<source id=2>b</source>"
