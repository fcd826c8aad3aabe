"""Text classifiers: TF-IDF over characters or words on Spark ML, with a linear head, or components and a layered one."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.deobfuscate import deobfuscate
from ..functions.terms import terms
from ..sources.scratch import written
from .calibrate import best_threshold, sweep
from .layered import LayeredModel, fit_layers
from .metrics import auroc, robustness
from .sampling import PARTS, SEED, grouped_split
from .spread import pieces, spread


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words padded with a blank on either side."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 0), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    of_size = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.concat(*[of_size(w, n) for n in range(low, high + 1)])))


class TextWeights(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Texts as weights of their terms, (1 + ln count) * idf, scaled to length one. ``kind``: ``char`` n-grams of 2 to 5, or
    ``word`` n-grams of 1 and 2. ``idf`` is ln((1 + texts) / (1 + texts with the term)) + 1. Texts go from words to numbers
    in one Arrow function, and no terms are written anywhere."""

    kind = Param(Params._dummy(), "kind", "char or word", TypeConverters.toString)
    terms = Param(Params._dummy(), "terms", "vocabulary", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "weight of each term", TypeConverters.toListFloat)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, kind: str | None = None, terms: list[str] | None = None, idf: list[float] | None = None):
        super().__init__()
        given = (("inputCol", inputCol), ("outputCol", outputCol), ("kind", kind), ("terms", terms), ("idf", idf))
        self._set(**{k: v for k, v in given if v is not None})

    @property
    def vocabulary(self) -> list[str]:
        return self.getOrDefault(self.terms)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.vectors(dataset, dataset.columns)

    def vectors(self, dataset: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep`` and the weights."""
        size = len(self.vocabulary)

        def vectors(sizes: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> pa.Array:
            ends, rows = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), len(sizes)
            lists = [pa.ListArray.from_arrays(ends, part) for part in (numbers.astype(np.int32), values)]
            return pa.StructArray.from_arrays([pa.array(np.zeros(rows, np.int8)), pa.array(np.full(rows, size, np.int32)), *lists], names=["type", "size", "indices", "values"])

        return self._mapped(dataset, keep, StructField(self.getOutputCol(), VectorUDT()), vectors)

    def chances(self, dataset: DataFrame, keep: list[str], coefficients: np.ndarray, intercept: float) -> DataFrame:
        """The columns ``keep`` and the probability by a linear model of the weights, which are not handed on."""
        broadcast = dataset.sparkSession.sparkContext.broadcast(coefficients)

        def chances(sizes: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> pa.Array:
            margins = intercept + np.bincount(np.repeat(np.arange(len(sizes)), sizes), values * broadcast.value[numbers], len(sizes))
            return pa.array(np.exp(-np.logaddexp(0, -margins)))

        return self._mapped(dataset, keep, StructField("probability", DoubleType()), chances)

    def _mapped(self, dataset: DataFrame, keep: list[str], field: StructField, made: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
        kind, text = self.getOrDefault(self.kind), self.getInputCol()
        held = dataset.sparkSession.sparkContext.broadcast((self.vocabulary, np.array(self.getOrDefault(self.idf))))
        at = dataset.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, idf = held.value
            known = terms(kind, vocabulary)
            for piece in (p for batch in batches for p in pieces(batch, text, 4)):
                made_of = made(*weighed(*known.counts(piece.column(at).to_pylist()), idf))
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], made_of], names=[*keep, field.name])

        return dataset.mapInArrow(run, StructType([*[dataset.schema[c] for c in keep], field]))


def weighed(sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of some texts' terms as weights, of length one for each text that has any."""
    weights = (1 + np.log(counts)) * idf[numbers]
    some = sizes > 0
    squares = np.add.reduceat(weights * weights, (np.cumsum(sizes) - sizes)[some]) if len(weights) else weights
    return sizes, numbers, weights / np.repeat(np.maximum(np.sqrt(squares), 1e-300), sizes[some])


#: Terms that a task counts before it hands them on, and how many times as many where they are held as numbers.
HELD, WIDER = 300_000, {"char": 1, "word": 8}


def _summed(keys: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """The different keys, and the sums of the numbers of each."""
    found = pa.array(keys).dictionary_encode()
    at, size = found.indices.to_numpy(), len(found.dictionary)
    return [found.dictionary.to_numpy(), *[np.bincount(at, n, size).astype(np.int64) for n in numbers]]


def _statistics(texts: DataFrame, kind: str, features: int | None = None) -> DataFrame:
    """(term, df, total, passed) of a column of texts. A task adds up its rows' terms, so few of them are shuffled. With
    ``features`` it also passes over rare ones: those that it has at most ``passed`` times, less than half as often as the
    last of so many. A row without a term has the number of texts as df, and ``passed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, size, texts, most = terms(kind), [], 0, 0, HELD * WIDER[kind]

        def made() -> pa.RecordBatch:
            keys, df, total = _summed(*map(np.concatenate, zip(*held)))
            passed = 0 if features is None or len(keys) <= features else (int(np.partition(total, -features)[-features]) - 1) // 2
            keys, df, total = (x[total > passed] for x in (keys, df, total))
            of_term = [pa.concat_arrays([found.names(keys), pa.nulls(1, pa.string())]), *[pa.array(np.append(x, last)) for x, last in ((df, texts), (total, 0))]]
            return pa.RecordBatch.from_arrays([*of_term, pa.array(np.full(len(keys) + 1, passed))], names=["term", "df", "total", "passed"])

        for piece in (p for batch in batches for p in pieces(batch, batch.schema.names[0], 4)):
            held.append(found.statistics(piece.column(0).to_pylist()))
            size, texts = size + len(held[-1][0]), texts + piece.num_rows
            if size > most:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
            if size > most // 2 and len(held) == 1:
                yield made()
                found, held, size, texts = terms(kind), [], 0, 0
        if held:
            yield made()

    return texts.mapInArrow(run, "term string, df bigint, total bigint, passed bigint").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "total", "passed")])


def _statistics_of(texts: DataFrame, kind: str, vocabulary: list[str]) -> DataFrame:
    """(term, df, total) of the listed terms alone."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms(kind, held.value)
        df, total = np.zeros((2, len(held.value)), np.int64)
        for piece in (p for batch in batches for p in pieces(batch, batch.schema.names[0], 4)):
            _, numbers, counts = known.counts(piece.column(0).to_pylist())
            df += np.bincount(numbers, minlength=len(df))
            total += np.bincount(numbers, counts, len(total)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held.value, pa.string()), pa.array(df), pa.array(total)], names=["term", "df", "total"])

    return texts.mapInArrow(run, "term string, df bigint, total bigint")


def _of_use(texts: DataFrame, kind: str, features: int, least: int, most: float) -> tuple[DataFrame, int]:
    """(term, df, total) with all terms that ``_chosen`` can choose, and the number of texts. Pairs of words are mostly rare,
    and there are more of them the more texts there are. So tasks first pass over what is rare there: of each term that
    gives bounds of its counts, ``features`` of which tell a total that the chosen ones reach at least, and only terms that
    can reach it are counted in full. Where the bounds tell too little, all terms are counted."""
    every = _statistics(texts, kind, features if kind == "word" else None)
    if kind != "word":
        return every.filter(F.col("term").isNotNull()), texts.count()
    found = written(every, "terms")
    whole = found.filter(F.col("term").isNull()).first()
    if whole is None:
        return found, 0
    found, rows, unseen = found.filter(F.col("term").isNotNull()), whole["df"], whole["passed"] - F.col("passed")
    if whole["passed"] == 0:
        return found, rows
    sure = found.filter((F.col("df") >= least) & (F.col("df") + unseen <= most * rows)).groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    reached, last = 0, 0
    for total, n in sorted(sure.collect(), reverse=True):  # d different totals need d * d / 2 words
        reached, last = reached + n, total
        if reached >= features:
            break
    if reached >= features and last > whole["passed"]:
        can = found.filter((F.col("total") + unseen >= last) & (F.col("df") + unseen >= least) & (F.col("df") <= most * rows))
        names = [r["term"] for r in can.select("term").limit(4 * features + 1).collect()]
        if len(names) <= 4 * features:
            return _statistics_of(texts, kind, names), rows
    return _statistics(texts, kind).filter(F.col("term").isNotNull()), rows


def _chosen(statistics: DataFrame, rows: int, features: int, least: int, most: float) -> tuple[list[str], np.ndarray]:
    """The vocabulary and its idf. Of the terms that are in ``least`` texts and at most a share of ``most``, the
    ``features`` most frequent ones stay, in that order; ties go by term."""
    stats = statistics.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    kept = stats.filter((F.col("df") >= least) & (F.col("df") <= most * rows)).orderBy(F.desc("total"), "term").limit(features).collect()
    return [r["term"] for r in kept], np.log((1 + rows) / (1 + np.array([r["df"] for r in kept], float))) + 1


def weights(docs: DataFrame, kind: str = "char", key: str = "id", *, features: int = 60_000, least: int = 2, most: float = 0.98) -> DataFrame:
    """(key, term, weight): the same weights as rows. The driver and each task hold the vocabulary, at most ``features``
    terms. A key's terms are counted and weighed where its row is; those of keys that several rows have are grouped."""
    docs = docs.select(key, "text")
    many = docs.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("again")).filter("again").withColumnRenamed(key, "_key")
    joined = docs.join(many, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "text", F.coalesce("again", F.lit(False)).alias("again"))
    found = written(spread(joined, docs), "texts")
    alone, again = found.filter(~F.col("again")).select(key, "text"), found.filter("again").select(key, "text")
    kind_of_key = found.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, "text")):
            found = terms(kind)
            sizes, numbers, counts = found.counts(piece.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), found.names(numbers), pa.array(counts)], names=["key", "term", "n"])

    counted = again.mapInArrow(count, StructType([StructField(key, kind_of_key), StructField("term", StringType()), StructField("n", LongType())])).groupBy(key, "term").agg(F.sum("n").alias("n"))
    grouped = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
    vocabulary, idf = _chosen(_statistics(alone.select("text"), kind).filter(F.col("term").isNotNull()).drop("passed").unionByName(grouped), found.count(), features, least, most)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = held.value
        known, words = terms(kind, vocabulary), pa.array(vocabulary, pa.string())
        for piece in (p for batch in batches for p in pieces(batch, "text")):
            sizes, numbers, values = weighed(*known.counts(piece.column(1).to_pylist()), idf)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), words.take(pa.array(numbers)), pa.array(values)], names=["key", "term", "weight"])

    of_one = alone.mapInArrow(weigh, StructType([StructField(key, kind_of_key), StructField("term", StringType()), StructField("weight", DoubleType())]))
    kept = docs.sparkSession.createDataFrame(list(zip(vocabulary, idf.tolist())), "term string, idf double")
    raw = counted.join(F.broadcast(kept), "term").select(key, "term", ((1 + F.log("n")) * F.col("idf")).alias("raw"))
    length = raw.groupBy(F.col(key).alias("_key")).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return of_one.unionByName(raw.join(length, F.col(key).eqNullSafe(F.col("_key"))).select(key, "term", (F.col("raw") / F.col("length")).alias("weight")))


def tfidf(df: DataFrame, kind: str = "char", *, features: int = 60_000, least: int = 2, most: float = 0.98) -> tuple[list, DataFrame]:
    """The fitted stages from text to weights, the last one with the vocabulary; and the other columns of ``df`` with
    ``features``."""
    vocabulary, idf = _chosen(*_of_use(df.select("text"), kind, features, least, most), features, least, most)
    stages = [TextWeights("text", "features", kind, vocabulary, idf.tolist())]
    return stages, stages[-1].vectors(df, [c for c in df.columns if c != "text"])


def fit(df: DataFrame, kind: str = "char", head: str = "logistic", *, features: int = 60_000, least: int = 2, most: float = 0.98, **layers) -> PipelineModel | LayeredModel:
    """A classifier of (text, label). ``head``: logistic, or layers, which is a truncated SVD, scaling and a hidden layer
    (``components``, ``hidden`` and the other options of :mod:`.layered`); their rows are dealt by ``id``, or by text
    where there is none. Features are written while it is fitted, so texts are weighed once."""
    key = F.col("id" if "id" in df.columns else "text").cast("string").alias("key")
    stages, rows = tfidf(df.select(key, "text", "label"), kind, features=features, least=least, most=most)
    if head == "layers":
        return fit_layers(PipelineModel(stages), rows, **layers)
    stages.append(LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-4, maxIter=50).fit(written(rows.select("label", "features"), "features")))
    return PipelineModel(stages)


def predicted(model: PipelineModel | LayeredModel, df: DataFrame, system: str, threshold: float = 0.5) -> DataFrame:
    """Prediction rows of a model, a loaded one too: ``df`` with system, probability, threshold and pred_label."""
    scored = probability(model, df)
    return scored.withColumns({"system": F.lit(system), "threshold": F.lit(threshold), "pred_label": (F.col("probability") >= threshold).cast("int")})


def normalized(df: DataFrame) -> DataFrame:
    """Rows whose text is its reconstruction."""
    return df.withColumn("text", deobfuscate("text"))


def used(trained_on: list[str], variant: Column, part: Column) -> Column:
    """Whether :func:`normalization_defence` looks at a text: the report is of all variants, but a model and its threshold
    come from those that it is trained on."""
    return (part == PARTS[-1][0]) | variant.isin(*trained_on)


def normalization_defence(rows: DataFrame, trained_on: list[str], system: str = "normalized", *, head: str = "layers", seed: int = SEED, **options) -> tuple[PipelineModel | LayeredModel, float, DataFrame]:
    """Defence by normalization of rows (id, variant, label, text), honestly tested: ids are split in three, with all their
    variants. The model is fitted on the reconstructed texts of the listed variants of the first part, its threshold is
    the best one on the same variants of the second, and the report, by variant, is of the third alone: the robustness
    with the threshold and the numbers of ids in each part. Returns the model, the threshold and the report."""
    parted = grouped_split(rows.select("id", "variant", "label", "text"), seed=seed)
    split = written(normalized(parted.withColumn("text", F.when(used(trained_on, F.col("variant"), F.col("part")), F.col("text")))), "defence")
    part = lambda name: split.filter(F.col("part") == name).drop("part")
    listed = F.col("variant").isin(*trained_on)
    model = fit(part("fit").filter(listed), head=head, **options)
    swept = sweep(written(probability(model, part("calibrate").filter(listed)).select("label", F.col("probability").alias("score")), "calibration"))
    found = best_threshold(swept).first()
    threshold = 0.5 if found is None else float(found["threshold"])
    sizes = split.agg(*[F.count_distinct(F.when(F.col("part") == name, F.col("id"))).alias(f"{name}_ids") for name, _ in PARTS])
    tested = written(predicted(model, part("test"), system, threshold), "tested")
    report = robustness(tested, threshold=threshold).join(auroc(tested, "variant").select("variant", "auroc"), "variant")
    return model, threshold, report.withColumn("threshold", F.lit(threshold)).crossJoin(F.broadcast(sizes))  # one row


def probability(model: PipelineModel | LayeredModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with the probability of label 1."""
    columns = keep or df.columns
    if isinstance(model, LayeredModel):
        return model.probability(df).select(*columns, "probability")
    weights, head = model.stages[0], model.stages[-1]
    if len(model.stages) == 2 and isinstance(weights, TextWeights) and isinstance(head, LogisticRegressionModel) and head.numClasses == 2:
        return weights.chances(df, columns, head.coefficients.toArray(), head.intercept)
    return model.transform(df).select(*columns, vector_to_array("probability")[1].alias("probability"))


def train_settings(clean: DataFrame, augmented: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The training sets: clean rows alone, with each augmentation, and with all of them."""
    out = {"clean_only": clean}
    out |= {f"aug_{name}": clean.unionByName(df) for name, df in augmented.items()}
    if len(augmented) > 1:
        every = clean
        for df in augmented.values():
            every = every.unionByName(df)
        out["aug_" + "_".join(augmented)] = every
    return out


def clip(text: str, budget: int) -> str:
    """Head and tail of a text that has more than ``budget`` characters."""
    return text if len(text) <= budget else f"{text[:budget // 2]} ... {text[len(text) - (budget - budget // 2):]}"


def searched_budget(text: str, candidate: str, count_tokens, most: int, least: int) -> tuple[int, int]:
    """(budget, tokens) by halving: a prompt is made and counted for each step."""
    size = lambda b: count_tokens(clip(text, b), clip(candidate, b))
    low, high = least, max(len(text), len(candidate), least)
    while low < high:  # invariant: low fits
        middle = (low + high + 1) // 2
        low, high = (middle, high) if size(middle) <= most else (low, middle - 1)
    return low, size(low)


def estimated_budget(text: str, candidate: str, count_tokens, ends, most: int, least: int) -> tuple[int, int]:
    """The same from one look at the tokens of the two whole texts: ``ends`` gives, in order, the characters where a
    text's tokens end. The tokens of a clipped text are about those that end in its head and start in its tail. A step of
    the search is decided by that number where it is further than ``MARGIN`` tokens from the bound, and only else by
    counting; each count sets the estimate right."""
    longest = max(len(text), len(candidate), least)
    found = [(len(t), ends(t)) for t in (text, candidate)]

    def about(budget: int) -> int:
        total = 0
        for length, stops in found:
            if length <= budget:
                total += len(stops)
            else:
                total += bisect.bisect_right(stops, budget // 2) + 2 + len(stops) - bisect.bisect_right(stops, length - (budget - budget // 2))
        return total

    exact: dict[int, int] = {}
    shift = 0

    def size(budget: int) -> int:
        nonlocal shift
        if budget not in exact:
            exact[budget] = count_tokens(clip(text, budget), clip(candidate, budget))
            shift = exact[budget] - about(budget)
        return exact[budget]

    def fits(budget: int) -> bool:
        over = about(budget) + shift - most
        return over <= 0 if exact and abs(over) > MARGIN else size(budget) <= most

    low, high = least, longest
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low, size(low)


#: Tokens by which cutting a text may change the number that its parts had in the whole.
MARGIN = 4


def fit_token_budget(df: DataFrame, count_tokens, *, most: int = 256, least: int = 16, ends=None) -> DataFrame:
    """Adds budget, token_count and truncated: the largest character budget whose prompt of (text, candidate) has at
    most ``most`` tokens by ``count_tokens(head and tail of the text, same of the candidate)``. Fails where even the
    least budget is too long. With ``ends``, the ends of a text's tokens in characters, a prompt is counted a few times
    and not for each step of a search."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def one(text: str, candidate: str) -> tuple[int, int, bool]:
        budget, size = estimated_budget(text, candidate, count_tokens, ends, most, least) if ends else searched_budget(text, candidate, count_tokens, most, least)
        if size > most:
            raise ValueError("the prompt is too long even at its least budget")
        return budget, size, len(text) > budget or len(candidate) > budget

    def run(batches):
        for pdf in batches:
            found = [one(t or "", c or "") for t, c in zip(pdf["text"], pdf["candidate"])]
            yield pdf.assign(budget=[f[0] for f in found], token_count=[f[1] for f in found], truncated=[f[2] for f in found])

    return df.mapInPandas(run, f"{columns}, budget int, token_count int, truncated boolean")
