import random
import re

import public_tokenizers
import tokenizers
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import langid, ngram_join, secrets


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(90001, "password = abcdefgh1234 and the of the with that from this is are", "en", "s", 60), (90002, None, "en", "s", 0), (90003, "12345", None, "s", 5)], docs.schema)
    now, kept = docs.unionByName(more), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}"
        stage(spark, now, folder).write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in after.collect()}
        before, now = now, after
    assert 90002 not in kept["language"] and 90003 not in kept["language"] and len(kept["language"]) > 0.9 * docs.count()
    sets = {d: frozenset(ngram_join.shingle_set(t).tolist()) for d, t in kept["near_duplicates"].items()}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[:i] if sets[a])
    assert set(kept["benchmark"]) <= set(kept["near_duplicates"]) and set(kept["secrets"]) == set(kept["benchmark"])
    assert kept["secrets"][90001].startswith("password = <secret> and")
    assert not any(re.search(r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}", t) for t in kept["secrets"].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["secrets"])


CLASHES = ["key", "cls", "comp", "id", "text_key", "row", "stays", "hit_id", "hit_key", "other_id", "__key", "text_read", "w", "pos", "token", "spans", "lang_pred", "rejected"]
PROSE = "the river ran past the old mill and the miller of the town was there to see that it did not stop for the night because this is what he had always done with the water"


def odd_documents(spark):
    """Nulls in each column, empty, letterless and very long texts, repeated rows, ties, and columns named as the stages' own."""
    rng = random.Random(2)
    words = PROSE.split()
    long = " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(60_000))
    rows = [(1, PROSE, "en", "s", 5), (2, PROSE, "en", "s", 5), (2, PROSE, "en", "s", 5), (3, long, "en", None, 5), (4, None, "en", "s", None), (5, "", None, None, 0), (6, "123 !!", "en", "s", 7), (None, f"{PROSE} and a null id of its own {long[:4000]}", None, "s", 1), (7, "mot " * 300, "fr", "s", 1), (8, f"api_key = {'q' * 9}77 {long[5000:9000]}", "en", "s", 1)]
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(t) for c, t in base.dtypes))
    return base.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(extra).select("*", *(F.lit("clash").alias(c) for c in CLASHES)), rows


def test_stages_with_odd_rows_and_clashing_names(spark):
    docs, rows = odd_documents(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}"
        stage(spark, docs, "/root/testdata/sf0.001").write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        docs, kept[name] = after, sorted((r.doc_id for r in after.where("doc_id is null or doc_id < 1000").collect()), key=repr)
    assert kept["language"] == [1, 2, 2, 3, 7, 8, None]
    assert kept["near_duplicates"] == kept["benchmark"] == kept["secrets"] == [1, 3, 7, 8, None]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} and whole.where("n <> m").count() == 0


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0


def test_run_against_plain_functions(spark):
    """Each stage of run() by a plain loop over all documents, in which every pair of texts is compared."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    learned = langid.language_dictionaries(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    now = {}
    for i, r in rows.items():
        text = langid.letters_only(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            continue
        sizes = []
        for content in learned.values():
            level = langid.LEVEL
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
            e = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(e.compress(text[at : at + langid.BLOCK])) for at in range(0, len(text), langid.BLOCK)))
        best, second = sorted(sizes)[:2]
        if best <= (1 - langid.MIN_MARGIN) * second:
            now[i] = r.text
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in now.items()}
    top = {i: i for i in now}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in now:
        for b in now:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    now = {i: t for i, t in now.items() if root(i) == i}
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = [x.lower() for x in word.findall(r.text)]
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = [x.lower() for x in word.findall(text)]
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    now = {i: secrets.redacted(t) for i, t in now.items() if clean(t)}
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in now.items()}
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == expected
