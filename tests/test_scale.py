"""What a task is given and holds does not grow with a table."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from glyphward.functions import hangul
from glyphward.functions import terms as grams
from glyphward.functions.terms import terms
from glyphward.operators import layered, models, obfuscate, spread


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_tasks_by_text(spark, monkeypatch):
    """A table in more partitions than there are cores, all its text in one of them."""
    monkeypatch.setattr(spread, "TASK", 1000)
    df = spark.createDataFrame([(i, "x" * 500) for i in range(40)], "id int, text string").coalesce(1).unionByName(spark.range(0, 0, 1, 8).selectExpr("cast(id AS int) AS id", "'' AS text"))
    found = spread.spread(df)
    assert found.rdd.getNumPartitions() == 20 and max(len(p) for p in found.rdd.glom().collect()) <= 10
    assert spread.spread(df.select("id", F.repeat("text", 10).alias("t")), df).rdd.getNumPartitions() == 20


def test_compatible_rows_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spread, "PIECE", 100)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 60, None, "b" * 40, "c", "d" * 300, "e"]})
    assert [p.num_rows for p in spread.pieces(batch, "text")] == [3, 1, 1, 1]
    rows = spark.createDataFrame([(i, "test", "가나다라 " * 9) for i in range(9)], "idx int, split string, text string").coalesce(1)
    plan = plan_of(obfuscate.obfuscate_compatible(rows))
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def plain_draw(key: str) -> float:
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32


def plain_runed(roman: str, at: str, share: float) -> str:
    return "".join(hangul.RUNES[hangul.LETTERS.index(c.lower())] if plain_draw(f"{at}|g|{j}") < share else c for j, c in enumerate(roman))


def plain_native(text: str, key: str | None, syllables: float, letters: float, mix: bool) -> str:
    out = []
    for i, c in enumerate(text):
        at, place = str(i) if key is None else f"{key}|{i}", ord(c) - 0xAC00
        roman = hangul.INITIALS[place // 588] + hangul.VOWELS[place % 588 // 28] + hangul.FINALS[place % 28] if 0 <= place < 11172 else None
        if mix and roman is None and c.isascii() and c.isalpha():
            roman = c
        if mix and c in hangul.CONFUSABLE and plain_draw(f"{at}|c") < hangul.CONFUSED_SHARE:
            out.append(hangul.CONFUSABLE[c])
        else:
            out.append(plain_runed(roman, at, letters) if roman is not None and plain_draw(at) < syllables else c)
    return "".join(out)


def test_native_forms_equal_a_plain_version(spark):
    """Also where there is no key or text, and for characters beyond the first plane; no draw is interpreted."""
    texts = ["가나다라마 바사아자차카타파하이오 Zeta é 가1", "", None, "𝒳가힣 　\x1c뷁kK", "각" * 60]
    df = spark.createDataFrame([(i, k, t) for i, t in enumerate(texts) for k in ("7|1", None)], "i int, k string, t string")
    for syllables, letters in ((0.35, 0.0), (0.7, 0.45), (1.0, 0.98), (0.0, 1.0), (1.0, 1.0)):
        for mix, make in ((False, obfuscate.obfuscate), (True, obfuscate.glyph_mix)):
            made = df.select("k", "t", make(F.col("t"), F.col("k"), syllables, letters).alias("o"))
            for r in made.collect():
                assert r.o == (None if r.t is None else plain_native(r.t, r.k, syllables, letters, mix))
            assert "ArrowEvalPython" in plan_of(made) and "transform(" not in plan_of(made)


def test_characters_are_counted_in_one_pass(spark):
    texts = ["Ab1 ᚨᛠ²①ㄱ　\x85é-가\x1c", "", None, "𝒳𝟗"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.c and tuple(r.c) for r in df.select(hangul.counts(F.col("t")).alias("c")).collect()]
    # length, blank, rune, runic, latin, digit, jamo, word; the second rune stands for no letter
    assert found == [(15, 4, 1, 2, 2, 3, 1, 10), (0,) * 8, None, (2, 0, 0, 0, 0, 1, 0, 2)]
    made = df.select(hangul.obfuscation_score(F.col("t")), hangul.rune_ratio(F.col("t")), hangul.latin_ratio(F.col("t")))
    assert "regexp_replace" not in plan_of(made)


def test_steps_of_small_batches_share_jobs(spark, monkeypatch):
    """The same training whether a batch is a job, or a chain of them is; with fewer jobs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(str(i), int(a[0] > 0), a.tolist()) for i, a in enumerate(x)], "key string, label int, x array<double>").repartition(3)
    jobs, found = [], []
    for chain in (1, 100, 1 << 16):
        monkeypatch.setattr(layered, "CHAIN", chain)
        spark.sparkContext.setJobGroup(f"chain {chain}", "")
        found.append(layered.train(df, 5, hidden=4, epochs=3, batch=20, rate=0.03, seed=7))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain {chain}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for other in found[1:]:
        assert np.allclose(np.array(found[0].history, float), np.array(other.history, float))
        assert all(np.allclose(a, b) for a, b in zip(found[0].weights, other.weights))
    assert jobs[0] - jobs[2] >= 30 and jobs[1] < jobs[0]


def plain_terms(text, kind):
    if kind == "word":
        words = re.findall(r"\w{2,}", (text or "").lower())
        return Counter([*words, *map(" ".join, zip(words, words[1:]))])
    words = [f" {w} " for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    return Counter(w[i:i + n] for w in words for n in range(2, 6) for i in range(len(w) - n + 1))


@pytest.mark.parametrize("kind", ["char", "word"])
def test_weights_of_keys(spark, kind, monkeypatch):
    """Rows of one key, and of none, are one text; no terms are shuffled for keys that one row has."""
    monkeypatch.setattr(models, "HELD", 20)
    rows = [("a", "Ab ab　cd  efg"), ("b", "ab zz_ 가나다"), ("a", "efg ab hi"), (None, "ab cd"), (None, "hi efg"), ("c", None), ("d", ""), ("e", "가나다 efg\x0bab cd")]
    texts, pieces_of = {}, Counter()
    for k, t in rows:
        texts.setdefault(k, Counter()).update(plain_terms(t, kind))
        pieces_of[k] += 1
    df = Counter(t for c in texts.values() for t in c)
    total = sum(texts.values(), Counter())
    kept = sorted((t for t in df if 2 <= df[t] <= 0.98 * len(rows)), key=lambda t: (-total[t], t.encode()))[:12]
    want = {}
    for k, c in texts.items():
        raw = {t: (1 + math.log(c[t])) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t in kept if t in c}
        want |= {(k, t): w / math.sqrt(sum(v * v for v in raw.values())) for t, w in raw.items()}
    found = models.weights(spark.createDataFrame(rows, "id string, text string").repartition(3), kind, features=12)
    assert {(r.id, r.term): r.weight for r in found.collect()} == pytest.approx(want)
    stages, features = models.tfidf(spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(rows)], "id string, text string"), kind)
    assert len(stages) == 1 and "Explode" not in plan_of(features) and "Generate" not in plan_of(features)


@pytest.mark.parametrize("way", ["bounds", "parts", "few"])
def test_rare_terms_are_passed_over(spark, monkeypatch, way):
    """The vocabulary is that of plain counts where tasks pass over rare terms, where the bounds tell too little, as parts of
    the table have other words, and where there are fewer terms than are asked for. A word of all texts is none."""
    monkeypatch.setattr(models, "HELD", 500)
    rng = np.random.default_rng(5)
    texts = []
    for i in range(400):
        words = rng.integers(60, size=30) + 1000 * (i % 4) if way == "parts" else np.minimum(rng.zipf(1.3, 30), 5000)
        texts.append(" ".join(["all", *(f"w{w}" for w in words)]))
    counts, df, total = [plain_terms(t, "word") for t in texts], Counter(), Counter()
    for c in counts:
        df.update(c.keys())
        total.update(c)
    features = 100_000 if way == "few" else 40
    want = sorted((t for t in df if 2 <= df[t] <= 0.98 * len(texts)), key=lambda t: (-total[t], t.encode()))[:features]
    asked, counted = [], models._statistics_of
    monkeypatch.setattr(models, "_statistics_of", lambda d, k, names: asked.append(names) or counted(d, k, names))
    rows = spark.sparkContext.parallelize([(str(i), texts[i]) for k in range(4) for i in range(k, 400, 4)], 4).toDF("id string, text string")
    stages, _ = models.tfidf(rows, "word", features=features)
    assert stages[0].vocabulary == want and "all" not in want
    assert stages[0].getOrDefault("idf") == pytest.approx([math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in want])
    assert [len(names) < len(df) / 10 for names in asked] == ([True] if way == "bounds" else [])
    if way == "bounds":
        assert models._statistics(rows.select("text"), "word", features).count() < len(df) / 4


def test_chances_take_no_vectors(spark):
    """Of a text only its chance is handed on, the same as by the model's stages, also for a text without known words."""
    df = spark.createDataFrame([(i, f"{'good nice' if i % 2 else 'bad vile'} kind {i % 7}", i % 2) for i in range(60)] + [(60, "", 0), (61, None, 1)], "id int, text string, label int")
    model = models.fit(df, "word", features=50)
    found = models.probability(model, df, ["id"])
    assert found.columns == ["id", "probability"] and "vector" not in plan_of(found) and "UDF" not in plan_of(found)
    want = {r.id: r.probability[1] for r in model.transform(df).collect()}
    assert {r.id: r.probability for r in found.collect()} == pytest.approx(want, abs=1e-12)
    assert models.probability(model, df).columns == ["id", "text", "label", "probability"]


def test_words_of_many_texts_at_once():
    """Terms of texts counted together, by number with and without a vocabulary, against plain counts."""
    texts = ["", None, "a", "Ab ab_ x cd,éß\nAB cd", "ΟΔΟΣ İx 가나 𝒳𝒳२ zz", "  cd cd cd  ", "b"]
    want = [plain_terms(t, "word") for t in texts]
    known = [t for t in sorted(set().union(*want)) if t != "cd"]
    for found, names in ((terms("word"), None), (terms("word", [*known, "no", "no cd"]), [*known, "no", "no cd"])):
        sizes, numbers, counts = found.counts(texts)
        of = found.names(numbers).to_pylist() if names is None else [names[n] for n in numbers]
        got = [Counter(dict(zip(of[end - n:end], counts[end - n:end].tolist()))) for n, end in zip(sizes, np.cumsum(sizes))]
        assert got == [Counter({t: n for t, n in w.items() if names is None or t in names}) for w in want]
    every = terms("word")
    numbers, df, total = every.statistics(texts)
    got = {t: (int(d), int(n)) for t, d, n in zip(every.names(numbers).to_pylist(), df, total)}
    assert got == {t: (sum(t in w for w in want), n) for t, n in sum(want, Counter()).items()}


def test_n_grams_by_arrays(spark, monkeypatch):
    """Few words recur, so no n-grams are made word by word; where characters are more than digits, a text's are looked up."""
    texts = [" ".join(f"{chr(0xAC00 + 7 * i + j)}b{i}c{j}" for j in range(20)) + "\x0b é\x1cé　𝒳 \n" for i in range(20)] + [None, ""]
    want = [plain_terms(t, "char") for t in texts]
    df, total = Counter(t for c in want for t in c), sum(want, Counter())
    vocabulary = sorted(total)[::2] + ["zz", "longer than any"]
    for base in (grams.BASE, 120):
        monkeypatch.setattr(grams, "BASE", base)
        monkeypatch.setattr(grams, "BEYOND", base**5)
        found = terms("char")
        numbers, rows, times = found.statistics(texts)
        assert not hasattr(found, "known") and bool(found.places) == (base == 120)
        summed = Counter(), Counter()  # a gram may have a number of either kind
        for name, n, k in zip(found.names(numbers).to_pylist(), rows.tolist(), times.tolist()):
            summed[0][name] += n
            summed[1][name] += k
        assert summed == (df, total)
        sizes, numbers, times = terms("char", vocabulary).counts(texts)
        ends = np.cumsum(sizes)
        for c, a, b in zip(want, ends - sizes, ends):
            assert {vocabulary[n]: k for n, k in zip(numbers[a:b], times[a:b])} == {t: n for t, n in c.items() if t in vocabulary} and (np.diff(numbers[a:b]) > 0).all()


def test_products_by_tiles(monkeypatch):
    """Crowded tiles and the rest, in blocks of several rows and of one; no product holds a row's features apart for each few rows."""
    monkeypatch.setattr(layered, "TILE", 16)
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((70, 90)) < np.r_[np.full(30, 0.5), np.full(60, 0.01)], rng.normal(size=(70, 90)), 0.0)
    dense[7] = 0
    rows, places = np.nonzero(dense)
    sparse = layered.Sparse(np.searchsorted(rows, np.arange(71)), places, dense[rows, places])
    right = rng.normal(size=(90, 5))
    for entries, n in ((1 << 20, 1), (100, 70)):
        monkeypatch.setattr(layered, "ENTRIES", entries)
        blocks = list(sparse.blocks())
        assert 1 <= len(blocks) <= n and any(b.tiles for b in blocks) and any(len(b.rest[0]) for b in blocks)
        total = np.zeros((90, 5))
        sparse.add_squared_times(right, total)
        assert np.allclose(sparse.times(right), dense @ right) and np.allclose(total, dense.T @ (dense @ right))


def test_a_share_for_each_core(spark, monkeypatch):
    """However many parts rows lie in, as many shares of features x width numbers are handed on as there are cores."""
    x = np.random.default_rng(3).normal(size=(40, 6))
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["v"]).repartition(20)
    parts, plain = [], layered._squared_times
    monkeypatch.setattr(layered, "_squared_times", lambda rows, *a: parts.append(rows.rdd.getNumPartitions()) or plain(rows, *a))
    values, _ = layered.truncated_svd(df, "v", 6, 6)
    assert np.allclose(values, np.linalg.svd(x)[1]) and set(parts) == {spark.sparkContext.defaultParallelism}


def test_texts_that_nothing_looks_at_are_not_made(spark):
    """Variants that no model is trained on are made of reported texts alone; what is made is as before."""
    rows = spark.createDataFrame([(i, "test", "가나다라 " * 5, [] if i % 3 == 0 else ["romanized_70"] if i % 3 == 1 else None) for i in range(9)], "idx int, split string, text string, wanted array<string>")
    every = {(r.idx, r.variant): r for r in obfuscate.obfuscate_compatible(rows.drop("wanted")).collect()}
    found = obfuscate.obfuscate_compatible(rows, wanted="wanted").drop("wanted").collect()
    assert Counter(r.idx for r in found) == {i: (1, 4)[i % 3 - 1] for i in range(9) if i % 3} and all(every[r.idx, r.variant] == r for r in found)
