"""Toxicity of documents: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (whole, of any language): densities of two lexicons, a fixed one and one learned from labelled
training documents by the odds of their words and of their words' beginnings; how near lexicon words stand to words of the second person; rates of
capitals, punctuation and obfuscation (digits or signs inside a word, stretched letters, spelled-out words). Words are
looked up as written and once more with obfuscation undone.

Training: labelled rows go by a hash of their id to two halves. Each half's features use the lexicon that the other half
teaches, so no words are judged on rows that taught them; of these rows two thirds teach the trees and one third the
calibration. Texts are scored with the lexicon of both halves. At most ``TRAIN_ROWS`` labelled rows are used,
those of the least hashes: a bounded sample, as a classifier needs. Every text is scored.

Defined results: null and empty texts have all features 0 and are scored as such; without labels of both kinds every
score is the share of label 1 (0 without labels); rows of equal text have equal scores; an empty table gives an empty
table; only the columns named are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.runtime import checkpointed

#: Labelled rows used, terms of the learned lexicon, and the shortest and longest beginning of a word that is a term.
TRAIN_ROWS, LEARNED_TERMS, SHORTEST, LONGEST = 20_000, 3_000, 3, 7
#: Words a worker remembers with what they count as.
MEMO_WORDS = 200_000
TREES, DEPTH = 20, 3

# Common insults and slurs of mild to strong kind, as a starting lexicon.
INSULTS = frozenset(
    """
    idiot idiots idiotic moron morons moronic stupid dumb dumbass fool foolish imbecile cretin clown loser losers trash garbage
    scum pathetic worthless disgusting useless ugly pig filth filthy vermin freak creep jerk bastard bitch asshole shit fuck
    fucking crap damn hate kill die retard retarded whore slut dick coward liar parasite rat disgrace vile
    idiote imbecile stupide debile connard salaud ordure dechet nul minable degoutant pathetique
    idiot dumm dummkopf bloedmann trottel arschloch abschaum muell wertlos ekelhaft erbaermlich verlierer
    idiota estupido imbecil basura asqueroso patetico inutil escoria perdedor payaso
    """.split()
)
# Words of the second person in English, French, German and Spanish.
SECOND_PERSON = frozenset("you your yours yourself youre ur u tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch tú ti usted ustedes vosotros tuyo".split())
# Signs and digits that stand for letters.
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"})

FEATURES = [
    "fixed_density", "fixed_count", "learned_density", "learned_count", "learned_best", "learned_weight", "disguised", "second_person", "nearness",
    "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "length",
]
_EDGE = ".,;:!?\"'()[]{}<>«»“”„…-–—*_~#%&$^+=|/\\@"
_WORD = re.compile(r"[^\W_]+")
_SPELLED = re.compile(r"\b\w(?:[\s.\-*_]\w){3,}\b")
_STRETCHED = re.compile(r"(\w)\1{2,}")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def plain(word: str) -> str:
    """A word with obfuscation undone: letters for signs and digits, no signs inside, no stretched letters."""
    return _STRETCHED.sub(r"\1", "".join(_WORD.findall(word.translate(LETTERS))))


class Lexicon(dict):
    """What a word counts as: (in the fixed lexicon, log odds in the learned one, disguised, obfuscated, second person)."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned

    def odds(self, word: str) -> float:
        found = self.learned.get
        return max(found(word, 0.0), *[found(f"{word[:k]}~", 0.0) for k in range(SHORTEST, LONGEST + 1)])

    def __missing__(self, word: str) -> tuple:
        bare = word.strip(_EDGE)
        fixed, odds, disguised, odd = bare in INSULTS, self.odds(bare), False, False
        if not fixed and not bare.isalpha() and len(bare) > 2 and not bare.isdigit():
            odd = any(map(str.isalpha, bare)) and not all(c.isalpha() or c in "'’-" for c in bare)
            disguised = odd and plain(bare) in INSULTS
        elif not fixed and _STRETCHED.search(bare):
            odd, disguised = True, plain(bare) in INSULTS
        out = self[word] = (fixed, odds, disguised, odd, bare in SECOND_PERSON)
        return out


_NOTHING = (False, 0.0, False, False, False)


def features(text: str, lexicon: Lexicon) -> list[float]:
    lowered = text.lower().split()
    n = len(lowered)
    if not n:
        return [0.0] * len(FEATURES)
    if len(lexicon) > MEMO_WORDS:
        lexicon.clear()
    told = [(k, x) for k, x in enumerate(map(lexicon.__getitem__, lowered)) if x != _NOTHING]
    fixed = sum(x[0] for _, x in told)
    odds = [x[1] for _, x in told if x[1]]
    hits = [k for k, x in told if x[0] or x[1] or x[2]]
    persons = [k for k, x in told if x[4]]
    spelled = ["".join(_WORD.findall(m)) for m in _SPELLED.findall(" ".join(lowered))] if sum(len(w) == 1 for w in lowered) > 3 else []
    disguised = sum(x[2] for _, x in told) + sum(w in INSULTS for w in spelled)
    nearest = None
    if hits and persons:
        right = np.searchsorted(persons, hits)
        places = np.array(persons)
        nearest = int(np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - hits), np.abs(places[np.maximum(right - 1, 0)] - hits)).min())
    capitals = _UPPER.findall(text)
    return [
        100 * fixed / n, math.log1p(fixed), 100 * len(odds) / n, math.log1p(len(odds)), max(odds, default=0.0), 100 * sum(odds) / n, math.log1p(disguised), 100 * len(persons) / n,
        0.0 if nearest is None else 1 / (1 + nearest), sum(map(len, capitals)) / len(text), sum(len(c) > 2 for c in capitals) / n,
        sum(map(text.count, ".,;:!?")) / len(text), text.count("!") / len(text), (sum(x[3] for _, x in told) + len(spelled)) / n, math.log1p(n),
    ]


def featured(docs: DataFrame, learned: dict[str, float], extra: list[str], field: int | None = None) -> DataFrame:
    """``extra`` columns of docs and the features of column text, or of that field of column row, so that a text which
    is carried along crosses to Python once. ``learned`` has LEARNED_TERMS at most."""
    kept = [docs.schema[c] for c in extra]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} double" for c in FEATURES)])
    shipped = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shipped.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                texts = batch.column(len(extra)) if field is None else batch.column(extra.index("row")).field(field)
                found = np.array([features(t.as_py() or "", lexicon) for t in texts], np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], *[pa.array(found[:, k]) for k in range(len(FEATURES))]], [*extra, *FEATURES])

    return docs.select(*extra, *["text"] * (field is None)).mapInArrow(run, schema)


def learned_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms by the log odds of label 1 among the documents that hold them. ``labelled``: text, label; bounded.

    A term is a word, or the beginning of one (marked by ~). Only those are learned whose counts chance does not explain
    even among so many terms: by the likelihood ratio against the common share of label 1.
    """
    words = F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.btrim(w, F.lit(_EDGE)))
    begun = F.transform(F.array_distinct(words), lambda w: F.concat(F.array(w), F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("~")))))
    totals = labelled.agg(F.sum("label").alias("ones"), F.count("*").alias("rows")).first()
    ones, rows = totals["ones"] or 0, totals["rows"]
    if not 0 < ones < rows:
        return {}
    counts = labelled.select(F.explode(F.array_distinct(F.flatten(begun))).alias("term"), "label").groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("n"))
    counts = checkpointed(counts.filter("a > 2 and length(term) > 2"))
    share, zeros = ones / rows, rows - ones
    b = F.col("n") - F.col("a")
    ratio = 2 * (F.col("a") * F.log(F.col("a") / (F.col("n") * share)) + F.when(b > 0, b * F.log(b / (F.col("n") * (1 - share)))).otherwise(0.0))
    odds = F.log((F.col("a") + 0.5) / (ones + 1)) - F.log((b + 0.5) / (zeros + 1))
    least = 2 * math.log(max(counts.count(), 2)) + 4
    best = counts.select("term", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("odds") > 2) & (F.col("ratio") > least)).orderBy(F.desc("ratio"), "term").limit(LEARNED_TERMS).collect()
    return {r["term"]: r["odds"] for r in best}


def score(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", carry: bool = False) -> DataFrame:
    """A row for each row of ``docs``: id, held_out, score from 0 to 1, predicted (1 from a score of 0.5).

    With ``carry`` also row: a struct of the columns of ``docs``. Labels of rows where ``held_out`` (of column id) is true are not learned from.
    """
    # here, as the workers that read texts import this module and need none of it
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    extra = ["id", *["row"] * carry]
    field = [c.lower() for c in docs.columns].index(text.lower()) if carry else None
    plain_docs = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry)
    marks = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    draw = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(6 << 20))
    sample = marks.filter(~F.coalesce(held_out, F.lit(False))).groupBy("id").agg(F.max("label").alias("label")).withColumn("draw", draw).orderBy("draw", "id").limit(TRAIN_ROWS)
    known = checkpointed(plain_docs.select("id", "text").join(F.broadcast(sample), "id").withColumn("part", F.pmod("draw", F.lit(6))))  # TRAIN_ROWS rows at most
    half = F.col("part") % 2
    lexicon = learned_lexicon(known)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = checkpointed(featured(known.filter(half == 0), learned_lexicon(known.filter(half == 1)), ["id", "label", "part"]).unionByName(featured(known.filter(half == 1), learned_lexicon(known.filter(half == 0)), ["id", "label", "part"])))
    scored = featured(plain_docs, lexicon, extra, field)
    seen = train.groupBy((F.col("part") > 3).alias("calibrates")).agg(F.sum("label").alias("ones"), F.count("*").alias("rows")).collect()
    enough = {r["calibrates"] for r in seen if 0 < r["ones"] < r["rows"]}
    if enough == {False, True}:
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, subsamplingRate=1.0, seed=5, maxBins=32, cacheNodeIds=False)
        model = trees.fit(assembler.transform(train.filter("part < 4").repartition(1)))
        raised = lambda df: model.transform(assembler.transform(df)).withColumn("raw", vector_to_array("rawPrediction")[1])
        calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raised(train.filter("part > 3")).select("raw", F.col("label").cast("double").alias("label")))
        out = calibrated.transform(raised(scored)).select(*extra, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
    else:
        ones, rows = sum(r["ones"] for r in seen), sum(r["rows"] for r in seen)
        out = scored.select(*extra, F.lit(ones / rows if rows else 0.0).alias("score"))
    return out.select(*extra, F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
