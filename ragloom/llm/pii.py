"""PII: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base rules find e-mail addresses, IP numbers, card numbers and phone numbers; their spans always stay.
Wider generators propose further spans: addresses spelled "name at host dot com"; phones without + in groups
of 2-5, 3-4 and 2-5 digits, or of 2-3 digits throughout (01 23 45 67 89, 912 34 56 78); runs of 11 to 21 digits,
so also card numbers that failed their check; + numbers of too few or too many digits; dotted quads that
failed their check or are written 10[.]0[.]0[.]1, and IPv6 addresses in full. Proposals may overlap each other;
those that meet a base span are dropped, as base spans stay. Boosted trees score a proposal by its format
(length, digits, separators, checksum) and by the words around it. Samples are dealt in four parts: two fit the trees, one
calibrates their score, and on the last the threshold of a generator is chosen, that which keeps its
selections at PRECISION. Of overlapping selections the best score stays.

The trees are fitted on the driver with samples drawn from templates (SAMPLES snippets, seeded), whose
features come from the same column expressions as the corpus's; scoring is a CASE WHEN expression.
Everything over the corpus is one pass without a shuffle.

Null texts are empty and have no spans. Texts are read whole. Repeated rows give repeated results; ties
in score go to the earlier, then the longer span. An empty table gives an empty result. Other columns
are ignored, so their names cannot clash.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .boosting import Trees, fit_trees, threshold
from .native import SPAN, count, empty_spans, find_spans, joined, let, luhn, only_digits

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive and anchored at the start of a run: the same leftmost matches as the plain
#: patterns, in time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Proposals beyond the base rules, and the kind that a selected one becomes.
PROPOSALS = {
    "spelled": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{2,64}+ ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?[A-Za-z]{2,10}+"),
    "local": ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{2,5}(?![0-9A-Za-z])"),
    "pairs": ("phone", r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,3}\)?(?:[ ./-][0-9]{2,3}){2,4}(?![0-9A-Za-z])"),
    "plus": ("phone", r"\+[0-9][ ().0-9-]+[0-9]"),
    "address": ("ip", r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| dot |\.)[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Za-z:])"),
    "run": ("card", r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){10,20}(?![0-9A-Za-z])"),
}
CONTEXT = 24
SAMPLES, SEED, PRECISION, ROUNDS = 5_400, 23, 0.98, 14

_PHONE = r"(?i)(phone|call|tel|mobile|cell|fax|whatsapp|dial|ring|reach|telefon|anruf|ruf |tél|appel|llam)"
_HOST = r"(?i)(\bip\b|host|server|address|login from|connect|ping|adresse|servidor|serveur)"
_CARD = r"(?i)(card|visa|master|amex|credit|debit|payment|pay|carte|karte|tarjeta)"
_MAIL = r"(?i)(mail|write|contact|reach|send|schreib|écri|escrib)"
_OTHER = r"(?i)(order|invoice|isbn|version|ticket|serial|ref|item|code|total|page|number of|date|since|born|sku|no\.)"
FEATURES = ("length", "digits", "groups", "spaces", "hyphens", "dots", "brackets", "letters", "luhn", "first_group", "phone_word", "card_word", "mail_word", "host_word", "other_word", "year", "colons", "hex", "greatest", "last_group")


def base_spans(text: Column) -> Column:
    """Array of the base spans, by kind as listed, then start."""
    checks = {
        "email": None,
        "ip": lambda s: F.forall(F.split(s["text"], r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        "card": lambda s: let(only_digits(s["text"]), lambda d: F.length(d).between(16, 19) & luhn(d)),
        "phone": lambda s: F.length(only_digits(s["text"])).between(8, 15),
    }
    found = []
    for kind in KINDS:
        spans = find_spans(text, kind, BASE[kind])
        found.append(F.filter(spans, checks[kind]) if checks[kind] else spans)
    return F.concat(*found)


def _features(text: Column, s: Column) -> Column:
    m = s["text"]
    before = F.lower(F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, s["start"] - F.greatest(s["start"] - CONTEXT, F.lit(0))))
    d = only_digits(m)
    n = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    flag = lambda x: x.cast("int")
    values = {
        "length": F.length(m),
        "digits": F.length(d),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))),
        "spaces": n(" "),
        "hyphens": n("-"),
        "dots": n("."),
        "brackets": n("()[]{}"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]+", "")),
        "luhn": flag(luhn(d)),
        "first_group": F.length(F.regexp_extract(m, "[0-9]+", 0)),
        "phone_word": flag(before.rlike(_PHONE)),
        "card_word": flag(before.rlike(_CARD)),
        "mail_word": flag(before.rlike(_MAIL)),
        "host_word": flag(before.rlike(_HOST)),
        "other_word": flag(before.rlike(_OTHER)),
        "year": flag(m.rlike(r"(?<![0-9])(19|20)[0-9]{2}(?![0-9])")),
        "colons": n(":"),
        "hex": F.length(F.regexp_replace(m, "[^A-Fa-f]+", "")),
        "greatest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]{1,9}"), F.lit(0)), lambda g: g.cast("int"))), F.lit(0)),
        "last_group": F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)),
    }
    return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])


def proposals(text: Column) -> Column:
    return F.concat(*[find_spans(text, name, pattern) for name, (_, pattern) in PROPOSALS.items()])


# ---------------------------------------------------------------- the model


def _snippets(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, str, int]]:
    """(generator, text, label) of seeded samples: what people write, and numbers that are something else."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeiou" if i % 2 else "bcdfglmnprst") for i in range(r.randint(3, 9)))
    filler = lambda: " ".join(word() for _ in range(r.randint(1, 4)))

    def checked(k: int) -> str:
        body = r.choice("3456") + digits(k - 2)
        total = sum((lambda x: x - 9 if x > 9 else x)(int(ch) * (2 - i % 2)) for i, ch in enumerate(reversed(body)))
        return body + str(-total % 10)

    def split(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    out = []
    for i in range(n):
        kind, good = ("spelled", "local", "run", "pairs", "plus", "address")[i % 6], r.random() < 0.5
        lead, tail = filler(), filler()
        if kind == "spelled":
            a, d = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "{dot}")])
            text = f"{r.choice(['mail me', 'write to', 'contact', word()])}: {word()}{r.choice(['.', '_', ''])}{word()}{a}{word()}{d}{r.choice(['com', 'org', 'net', 'de'])}"
            if not good:
                text = f"meet {word()} at {word()} dot {word()}{word()}"
        elif kind == "local":
            style = r.randint(0, 3)
            number = (f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(4)} {digits(3)}", f"0{digits(2)}/{digits(4)}{digits(3)}")[style]
            text = f"{r.choice(['call', 'phone', 'tel.', 'mobile', 'fax', 'my cell is'])} {number}"
            if not good:
                text = r.choice([f"order {digits(3)}-{digits(4)}-{digits(3)}", f"{r.choice(['19', '20'])}{digits(2)}-{digits(4)}", f"version {digits(2)}.{digits(3)}.{digits(2)}", f"{word()} {digits(3)} {digits(3)} {digits(3)}", f"pages {digits(3)}-{digits(3)}", f"total {digits(3)}.{digits(3)}.{digits(2)}", f"{word()} {digits(4)} {digits(4)} {digits(4)}"])
        elif kind == "pairs":
            pairs = lambda k, sep: sep.join(digits(2) for _ in range(k))
            sep = r.choice([" ", " ", ".", "-"])
            number = r.choice([f"0{r.randint(1, 9)}{sep}{pairs(4, sep)}", f"{r.choice('6789')}{digits(2)}{sep}{pairs(3, sep)}", f"{r.choice('6789')}{digits(2)}{sep}{digits(3)}{sep}{digits(3)}", f"0{digits(2)}{sep}{pairs(3, sep)}"])
            text = f"{r.choice(['tél.', 'appelez le', 'llame al', 'telefon', 'ruf an', 'call', 'mobile', 'mein anruf', 'phone'])} {number}"
            if not good:
                text = r.choice([f"{word()} {pairs(r.randint(3, 5), r.choice([' ', '-', '.']))}", f"scores {pairs(5, ' ')}", f"draw {pairs(4, '-')}", f"version {digits(2)}.{digits(2)}.{digits(3)}", f"pages {digits(3)} {digits(3)} {digits(2)}", f"total {digits(3)}.{digits(3)}.{digits(3)}", f"date {digits(2)}.{digits(2)}.{digits(2)}", f"ref {digits(3)}-{digits(2)}-{digits(3)}"])
        elif kind == "plus":
            number = r.choice([f"+{digits(2)} {digits(2)} {digits(3)}", f"+{digits(2)} {digits(5)}", f"+{digits(2)} ({digits(3)}) {digits(4)}-{digits(4)} {digits(4)}", f"+{digits(3)} {digits(7)} {digits(7)}", f"+{digits(1)}-{digits(3)}-{digits(2)}"])
            text = f"{r.choice(['call', 'phone', 'tel', 'mobile', 'fax', 'dial', 'telefon', 'llame'])} {number}"
            if not good:
                text = r.choice([f"{word()} +{digits(1)}.{digits(r.randint(1, 4))}", f"sum +{digits(2)} - {digits(2)}", f"from -{digits(1)} to +{digits(2)}", f"{word()} +{digits(3)}.{digits(2)}", f"total +{digits(18)}", f"score +{digits(2)}-{digits(2)}", f"{word()} +{digits(2)} {digits(3)}"])
        elif kind == "address":
            dot, part = r.choice(["[.]", "(.)", "[dot]", " dot "]), lambda: str(r.randint(0, 255))
            number = r.choice([dot.join(part() for _ in range(4)), ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8))])
            text = f"{r.choice(['ip', 'host', 'server', 'login from', 'ping', word()])} {number}"
            if not good:
                text = r.choice([f"{r.choice(['version', 'section', word()])} {r.randint(256, 999)}.{part()}.{part()}.{part()}", f"{r.choice(['version', word()])} {part()}.{r.randint(256, 999)}.{part()}.{r.randint(256, 999)}", f"at {':'.join(digits(2) for _ in range(8))}", f"chapter {' dot '.join(str(r.randint(1, 9)) for _ in range(4))}"])
        else:
            k = r.randint(13, 15)
            text = f"{r.choice(['card', 'visa', 'pay with', 'credit card no', 'amex'])} {split(checked(k), r.choice([' ', '-', '']))}"
            if not good:
                text = r.choice([f"isbn 978-{digits(10)}", f"serial {digits(r.randint(11, 20))}", f"{word()} {split(digits(r.randint(12, 19)), r.choice([' ', '-', '']))}", f"invoice {checked(k)}", f"ref {digits(14)}"])
        out.append((kind, f"{lead} {text} {tail}", int(good)))
    return out


@lru_cache(maxsize=1)
def _samples() -> tuple:
    return tuple(_snippets())


_FITTED: dict[str, dict[str, tuple[Trees, float]]] = {}


def models(spark: SparkSession) -> dict[str, tuple[Trees, float]]:
    """(trees, threshold) per generator; fitted once a process, from SAMPLES snippets."""
    if "all" not in _FITTED:
        rows = spark.createDataFrame(list(_samples()), "generator string, text string, label int")
        got = rows.select("generator", "label", "text", F.try_element_at(F.filter(proposals(F.col("text")), lambda s: s["kind"] == F.col("generator")), F.lit(1)).alias("s")).where("s is not null")
        found = got.select("generator", "label", _features(F.col("text"), F.col("s")).alias("f")).select("generator", "label", "f.*").collect()
        fitted = {}
        for name in PROPOSALS:
            own = [r for r in found if r["generator"] == name]
            x, y = np.array([[r[k] for k in FEATURES] for r in own]), np.array([r["label"] for r in own])
            part = np.arange(len(y)) % 4
            rest, cut = part != 3, part == 3
            trees = fit_trees(x[rest], y[rest], list(FEATURES), rounds=ROUNDS, hold=part[rest] == 2)
            fitted[name] = (trees, max(threshold(trees.probability(x[cut]), y[cut], PRECISION), 0.5))
        _FITTED["all"] = fitted
    return _FITTED["all"]


def _selected(text: Column, base: Column, fitted: dict) -> Column:
    """Proposals that pass their threshold, best first without overlaps, and clear of base spans."""

    def judge(s: Column) -> Column:
        def scored(f: Column) -> Column:
            p, least, kind = F.lit(0.0), F.lit(1.0), F.lit("")
            for name, (trees, cut) in fitted.items():
                here = s["kind"] == name
                p = F.when(here, trees.column(lambda k, f=f: f[k])).otherwise(p)
                least = F.when(here, F.lit(cut)).otherwise(least)
                kind = F.when(here, F.lit(PROPOSALS[name][0])).otherwise(kind)
            return F.struct((-p).alias("rank"), s["start"].alias("start"), (-s["end"]).alias("back"), (p >= least).alias("ok"), F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")).alias("span"))

        return let(_features(text, s), scored)

    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter(proposals(text), lambda s: ~F.exists(base, lambda b: meets(s, b)))

    def choose(open_: Column) -> Column:
        ranked = F.array_sort(F.filter(F.transform(open_, judge), lambda x: x["ok"]))
        return F.aggregate(ranked, empty_spans(), lambda a, x: F.when(F.exists(a, lambda b: meets(x["span"], b)), a).otherwise(F.concat(a, F.array(x["span"].cast(SPAN)))))

    return let(free, lambda o: F.when(F.size(o) == 0, empty_spans()).otherwise(choose(o)))


def _in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(place(s).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s.alias("s")))), lambda x: x["s"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end, text); spans are base and selected ones."""
    fitted = models(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("base", base_spans(F.col("t")))
    more = let(F.col("base"), lambda b: _selected(F.col("t"), b, fitted))
    return got.withColumn("more", more).select("doc_id", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(_in_order(F.concat("base", "more"), KINDS)).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_pii(c.table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
