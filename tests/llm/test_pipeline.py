"""run() against a brute-force version made of the plain functions of the other tests."""

import hashlib
import math
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_media_lines_urls import plain_dedup
from tests.llm.test_near_copies import plain_groups
from tests.llm.test_text_ops import plain_repeats
from tidemark.llm.repetition import Rules


def plain_kept(text):
    rules, n = Rules(), len((text or "").encode().split())
    near, far, longest = plain_repeats(text or "", rules.min_repeat_words)
    return n >= 50 and near <= 0.5 * n and far <= rules.max_covered_share * n and longest <= rules.max_longest_words


def plain_count(seed, doc_id, rate):
    parts, total = max(1, math.ceil(rate / 16)), 0
    for part in range(parts):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2**52
        term = cdf = math.exp(-rate / parts)
        k = 0
        while cdf <= u and k < 80:
            k += 1
            term *= rate / parts / k
            cdf += term
        total += k
    return total


def plain_run(rows):
    rows = [r for r in rows if plain_kept(r[1])]
    cut = {i: t for i, t, _ in plain_dedup(rows, 5)}
    rows = [(i, cut[i], s) for i, _, s in rows]
    groups = plain_groups([t for _, t, _ in rows])
    rows = [r for k, r in enumerate(rows) if groups[k] == k]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t)
    total, weight = sum(size.values()), {s: max(n, 1) ** 0.5 for s, n in size.items()}
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    out = []
    for i, t, s in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        out += [(i, len(ids), digest, decoded)] * plain_count(7, i, total * weight[s] / sum(weight.values()) / max(size[s], 1))
    return sorted(out)


def test_run_equals_brute_force(spark, tmp_path):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 1500")  # the plain version is quadratic
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.orderBy("doc_id").collect()]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain_run(rows) and len(got) > 200


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").dtypes == docs.dtypes


def test_run_over_whole_texts_and_edge_rows(spark, tmp_path):
    """All documents of the smallest size whatever their length, and null, empty, very long, repetitive and copied texts."""
    import random

    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    given = documents.orderBy("doc_id").first()
    texts = [None, "", " \n\t", " ".join(words), " ".join(words[:-40]), "again and again " * 3000, given["text"], " ".join(words) + "\nend."]
    more = spark.createDataFrame([(10**6 + k, t, "en", given["source"], len(t or "")) for k, t in enumerate(texts)], documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    table = documents.select(*more.columns).unionByName(more)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in table.orderBy("doc_id").collect()]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain_run([(i, t if len(t or "") < 40_000 else "", s) for i, t, s in rows]) and len(got) > 50  # the longest is all repetition, which the rules reject


def test_run_over_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    from tidemark.llm.common import shared_dir

    shared = shared_dir(spark).removeprefix("file:")
    before = {p.name for p in __import__("pathlib").Path("/" + shared.lstrip("/")).iterdir()}
    kept = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.name for p in __import__("pathlib").Path("/" + shared.lstrip("/")).iterdir()} - before
    assert [n.split("-")[0] for n in sorted(left) if not n.startswith("rdd")] == ["stage3"] and kept.count() > 0
