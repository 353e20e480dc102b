"""Secret scans: base patterns, and random strings told from identifiers by two character Markov models.

Base rules find assignments to secret names, access keys and long hexadecimal runs; their spans always
stay. The method adds tokens of LEAST characters or more that the first-order Markov model of random
strings explains better than that of ordinary identifiers and long words: the log-likelihood ratio summed over
the token's character pairs must exceed a threshold for the token's length. Nothing else decides: tokens
of letters alone or of digits alone are scored like others.

Both models are counts of character pairs in labelled samples (SAMPLES of each, seeded and made, not taken from the corpus;
a share HELD of them is held out of both). fit() adds to the ordinary ones the words of the corpus's own prose: runs of WORD letters
or more that stand in two different texts, counted over all whole texts. The threshold of a length lies midway between the
greatest ratio of held-out ordinary samples of about that length and that which 99 % of random ones exceed, above all
ordinary ones, and above all but PROSE_RATE of the prose's words of LEAST letters or more, to a bin of ratios (BIN). For that the
words of all texts are scored twice: by the model of the half of the texts that they are not counted from, so that no word clears
itself, and by the model of all. Words are counted and scored by Spark; the driver gets character pairs and bins.
Over the corpus the ratio is a lookup in one literal table; it is one pass of DataFrame functions without a shuffle.

Null texts are empty and have no spans. Texts are read whole. Repeated rows give repeated results. An
empty table gives an empty result. Other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .native import count, find_spans, joined, let

KINDS = ("assign", "access", "hex")
#: Base patterns, the same leftmost matches as the plain ones in time linear in the text.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{12,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
LEAST, SAMPLES, SEED, HELD = 12, 4_000, 29, 0.375
#: Lengths from which a threshold holds; the last is for all longer tokens.
LENGTHS = (12, 14, 16, 20, 28)
#: Prose: the letters of a word, the share of long words above a threshold, and the width of a bin of their ratios.
WORD, PROSE_RATE, BIN = 4, 0.001, 0.01
#: What a pair of the prose counts for in capitals.
CAPITALS = 0.1
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % LEAST

_WORDS = "user name file path index count value table column query result server client request response error message data list item node tree graph text token parse build test config option module class method object string number float array map set key cache store load save read write open close start stop first last next prev total average update delete insert select group order filter join merge split sort search match replace format encode decode public static final abstract default internal external version release branch commit head master remote origin local global session context state event handler listener callback promise future thread process worker queue stack buffer stream channel socket port host address domain route page view model controller service manager factory builder adapter proxy wrapper helper utility common shared base core main".split()

_PROSE = "information international communication understanding development environment organization responsibility characteristics nevertheless approximately infrastructure representative administration transformation pronunciation straightforward acknowledgement throughout although knowledge strength through thoughtful nicht zwischen wahrscheinlich geschwindigkeit wissenschaft entwicklung gesellschaft verantwortung bundesregierung selbstverständlich möglichkeiten schwierigkeiten unterschiedliche beschreibung durchschnitt rechtschreibung freundschaft gleichzeitig tatsächlich landwirtschaft aujourdhui gouvernement développement environnement malheureusement nouveaux beaucoup toujours quelques ceux oiseaux bateaux heureusement connaissance bibliothèque chevaux rechauffement particulièrement naturellement quelquefois lorsque jusque desarrollo conocimiento universidad investigación naturaleza comunicación responsabilidad ayuntamiento desafortunadamente pequeños trabajadores aproximadamente ejemplos siguientes quienes izquierda vergüenza".split()
_PROSE = [w for w in _PROSE if w.isascii()]

def base_spans(text: Column) -> Column:
    """The base spans of all kinds, by start, then kind as listed."""
    found = []
    for kind in KINDS:
        spans = find_spans(text, kind, BASE[kind])
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["text"], _VALUE, 1)) >= 8)
        found.append(spans)
    return in_order(F.concat(*found), KINDS)


def in_order(spans: Column, kinds: tuple[str, ...]) -> Column:
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), place(s).alias("k"), s["end"].alias("b"), s.alias("s")))), lambda x: x["s"])
    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(ordered))


def labelled(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """Seeded samples: random strings (1) and ordinary identifiers (0)."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    vowels, rest = "aeiou", "bcdfghklmnprstvwz"
    invented = lambda: "".join(r.choice(rest) + r.choice(vowels) + r.choice(("", "n", "r", "s", "t", "ch", "nd", "st")) for _ in range(r.randint(1, 4)))
    out = []
    for _ in range(n):
        k = r.randint(LEAST, 64)
        chars = r.choice((string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-", string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase))
        out.append((pick(chars, k), 1))
        words = [r.choice(_WORDS) if r.random() < 0.7 else invented() for _ in range(r.randint(2, 8))]
        words = words[: r.randint(1, 8)]
        style = r.randint(0, 6)
        name = ("_".join(words), "-".join(words), "/".join(words), "".join(w.title() for w in words), "_".join(words).upper(), "".join(words), "-".join(["2024", "01", *words, str(r.randint(1, 9999))]))[style]
        name += r.choice(("", "", str(r.randint(0, 99)), f"_v{r.randint(1, 9)}", "=" * r.randint(1, 8), "-" * r.randint(1, 30)))
        while len(name) < LEAST:
            name += r.choice("_-/") + r.choice(_WORDS)
        out.append((name, 0))
        # long words of prose, compounds and inflected forms
        name = "".join(r.choice(_PROSE) if r.random() < 0.7 else invented() for _ in range(r.randint(1, 2)))
        while len(name) < LEAST:
            name += r.choice(("", "-")) + r.choice(_PROSE)
        out.append((r.choice((str, str, str.title, str.upper))(name), 0))
    # rules and fillers that are drawn rather than written
    out += [(ch * r.randint(LEAST, 80), 0) for ch in "=-_/+" for _ in range(n // 50)]
    out += [("".join(r.choice("0123456789") for _ in range(r.randint(LEAST, 30))), 0) for _ in range(n // 20)]
    return out


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of character pairs, row by row of ALPHABET, and the threshold of each of LENGTHS."""

    table: tuple[float, ...]
    cuts: tuple[float, ...]


@lru_cache(maxsize=1)
def _samples() -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """The labelled samples as places in ALPHABET, and which are held out."""
    place = {ch: i for i, ch in enumerate(ALPHABET)}
    codes = [(np.array([place[ch] for ch in s]), y) for s, y in labelled()]
    return codes, np.random.default_rng(SEED).random(len(codes)) < HELD


def train(pairs: np.ndarray | None = None) -> Model:
    """The models of the labelled samples and of pairs, counts of a prose's character pairs."""
    size = len(ALPHABET)
    counts = np.full((2, size, size), 0.25)
    if pairs is not None:
        counts[0] += pairs
    codes, held = _samples()
    for (s, y), out in zip(codes, held, strict=True):
        if not out:
            np.add.at(counts[y], (s[:-1], s[1:]), 1)
    chance = np.log(counts / counts.sum(axis=2, keepdims=True))
    table = np.round(chance[1] - chance[0], 6)
    ratio = lambda s: float(table[s[:-1], s[1:]].sum())
    step = lambda n: sum(k <= n for k in LENGTHS) - 1
    scores: list[tuple[list[float], list[float]]] = [([], []) for _ in LENGTHS]
    for (s, y), out in zip(codes, held, strict=True):
        if out:
            scores[step(len(s))][y].append(ratio(s))
    most = [max(ordinary) for ordinary, _ in scores]
    cuts = [max(m + 2.0, 2.0, (m + float(np.quantile(rare, 0.01))) / 2) for m, (_, rare) in zip(most, scores, strict=True)]
    return Model(tuple(table.ravel().tolist()), tuple(cuts))


@lru_cache(maxsize=1)
def _fixed() -> Model:
    return train()


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The model of the labelled samples and of the prose of all docs."""
    text = F.col(text_col).cast("string")
    found = F.regexp_extract_all("t", F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]?[a-z]{%d,}+(?![A-Za-z0-9+/_=-])" % (WORD - 1)), F.lit(0))
    own = docs.select(text.alias("t"), F.xxhash64(text, F.lit(SEED)).alias("h")).select("h", F.explode(found).alias("w"))
    half = F.pmod("h", F.lit(2))
    words = own.groupBy("w").agg(F.count("*").alias("n"), F.sum(half).alias("odd"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    # a secret stands in one text and its copies, a word in texts that differ
    words = c.materialise(words.where("lo <> hi").select("w", F.array(F.col("n") - F.col("odd"), "odd").alias("n")), "prose")
    pair = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))
    pairs, place = np.zeros((2, len(ALPHABET), len(ALPHABET))), {ch: i for i, ch in enumerate(ALPHABET)}
    for r in words.select("n", F.explode(pair).alias("p")).groupBy("p").agg(*[F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in (0, 1)]).collect():
        for p, share in ((r["p"], 1.0), (r["p"].upper(), CAPITALS)):
            pairs[:, place[p[0]], place[p[1]]] += np.array([r["n0"], r["n1"]]) * share
    return _cleared(train(pairs.sum(axis=0)), [train(pairs[k]) for k in (0, 1)], words.where(F.length("w") >= LEAST))


def _cleared(fitted: Model, halves: list[Model], words: DataFrame) -> Model:
    """The model with thresholds above all but PROSE_RATE of the words (w, n by half) of each length, scored by it and by the other half's model."""
    step = sum(((F.length("w") >= k).cast("int") for k in LENGTHS[1:]), F.lit(0))
    scored = words.select("n", step.alias("k"), threshold(F.length("w"), fitted).alias("cut"), F.explode(F.array(
        *[F.struct(F.lit(way).alias("way"), log_ratio(F.col("w"), by).alias("ratio"), n.alias("n")) for way, by, n in
          (("other", halves[1], F.get("n", F.lit(0))), ("other", halves[0], F.get("n", F.lit(1))), ("all", fitted, F.get("n", F.lit(0)) + F.get("n", F.lit(1))))])).alias("s")).select("k", "cut", "s.*")
    bins = scored.where("n > 0").groupBy("way", "k", F.when(F.col("ratio") > F.col("cut"), F.ceil(F.col("ratio") / BIN)).alias("bin")).agg(F.sum("n").alias("n")).collect()
    cuts = list(fitted.cuts)
    for way, k in {(r["way"], r["k"]) for r in bins}:
        own = [(r["bin"], r["n"]) for r in bins if (r["way"], r["k"]) == (way, k)]
        above, allowed = 0, PROSE_RATE * sum(n for _, n in own)
        for at, n in sorted((x for x in own if x[0] is not None), reverse=True):
            above += n
            if above > allowed:
                cuts[k] = max(cuts[k], at * BIN)
                break
    return Model(fitted.table, tuple(cuts))


def model() -> tuple[tuple[float, ...], float]:
    """The fixed samples' log-likelihood ratios of character pairs, row by row of ALPHABET, and the least threshold of any length."""
    return _fixed().table, min(_fixed().cuts)


def threshold(n: int | Column, fitted: Model | None = None) -> float | Column:
    """The threshold of tokens of n characters."""
    cuts = (fitted or _fixed()).cuts
    if isinstance(n, int):
        return cuts[max(sum(k <= n for k in LENGTHS) - 1, 0)]
    out = F.lit(cuts[0])
    for k, v in zip(LENGTHS[1:], cuts[1:], strict=True):
        out = F.when(n >= k, F.lit(v)).otherwise(out)
    return out


def log_ratio(token: Column, fitted: Model | None = None) -> Column:
    """Summed log-likelihood ratio of random over ordinary."""
    values = F.array(*[F.lit(v) for v in (fitted or _fixed()).table])
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), code)
    return let(codes, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 2), F.lit(0.0), lambda a, i: a + F.get(values, F.get(x, i) * len(ALPHABET) + F.get(x, i + 1))))


def _more(text: Column, base: Column, fitted: Model | None = None) -> Column:
    """Tokens clear of base spans that the model of random strings explains better."""
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    return F.filter(find_spans(text, "random", TOKEN), lambda s: ~F.exists(base, lambda b: meets(s, b)) & (log_ratio(s["text"], fitted) > threshold(F.length(s["text"]), fitted)))


def spans_of(text: Column, fitted: Model | None = None) -> Column:
    """All spans of a text column, in order of start; null texts have none. Without a model the fixed samples' one."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return let(t, lambda x: let(base_spans(x), lambda b: in_order(F.concat(b, _more(x, b, fitted)), (*KINDS, "random"))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: Model | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end, text); spans add kind random to base. Without a model, fit() of docs."""
    fitted = fitted or fit(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).withColumn("base", base_spans(F.col("t")))
    more = _more(F.col("t"), F.col("base"), fitted)
    return got.withColumn("more", more).select("doc_id", "base", in_order(F.concat("base", "more"), (*KINDS, "random")).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(c.table(spark, sf_dir, "documents"))
    return got.select("doc_id", *[count(F.col("base"), k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
