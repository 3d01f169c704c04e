import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, pii, queries, repetition, token_histogram

WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))
RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


# --- repetition ---

def plain_repeats(text, least=16):
    w = text.encode().split()
    n = len(w)
    grams = Counter(zip(w, w[1:], w[2:]))
    near, far, longest = set(), set(), 0
    for i in range(n - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            near |= {i, i + 1, i + 2}
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                far |= set(range(i, i + k)) | set(range(j, j + k))
                longest = max(longest, k)
    return len(near), len(far), longest


def some_texts():
    random.seed(4)
    texts = ["", "a", "a a", "a " * 20, "a b c " * 9, " \n\t", "x" * 10_000]
    texts += [" ".join(random.choice("abcdef"[:k]) for _ in range(random.randint(0, 70))) for k in (1, 2, 3, 6) for _ in range(15)]
    passage = " ".join(random.choice("abcdefghijklmnop") for _ in range(60))
    return [*texts, f"{passage} x {passage} y {passage}", passage]


def test_repeats_equal_brute_force(docs):
    texts = some_texts()
    rows = {r["doc_id"]: r for r in repetition.score_quality(docs([*texts, None])).collect()}
    for k, t in enumerate(texts):
        r = rows[k]
        assert (r["n_repeat_words"], r["n_covered_words"], r["longest_repeat"]) == plain_repeats(t)
        words = re.findall("[^\x20\x09-\x0d]+", t)
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
    assert rows[len(texts)]["n_words"] == 0 and not rows[len(texts)]["kept"]


def test_counts_and_verdicts(docs):
    text = "a#b $c\n\n a#b $c\na#b $c\n \n" + " ".join(f"w{k}" for k in range(60))
    (row,) = repetition.score_quality(docs([text])).collect()
    assert row["n_symbols"] == 6 and row["n_dup_lines"] == 1 and row["kept"]
    unique = " ".join(f"u{k}" for k in range(40))
    phrase = " ".join(f"p{k}" for k in range(30))
    (row,) = repetition.score_quality(docs([f"{unique} {phrase} x {phrase} y {unique[::-1]} {' '.join(map(str, range(70)))}"])).collect()
    assert not row["base_failed"] and row["longest_repeat"] == 30 and not row["kept"]  # 60 of 173 words
    long = " ".join(f"q{k}" for k in range(101))
    filler = " ".join(f"f{k}" for k in range(1000))
    for passage, kept in ((long, False), (long.removesuffix(" q100"), True)):
        (row,) = repetition.score_quality(docs([f"{passage} x {filler} {passage} y"])).collect()
        assert row["longest_repeat"] == len(passage.split()) and row["kept"] == kept


def test_keep_quality_keeps_columns_and_rows(docs):
    good = " ".join(f"w{k}" for k in range(80))
    table = docs([good, "short", good, None]).withColumnRenamed("lang", "kept")
    kept = repetition.keep_quality(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
    assert repetition.keep_quality(table.where("false")).count() == 0


# --- personal data ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+".replace(r"\x20-", " -"),
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c.isdigit())
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_spans_equal_the_patterns():
    random.seed(5)
    automaton = pii._automaton()
    for alphabet in ("a@.1", "1 -.+", "0123456789.", "@ab.-+% é", "+1() .-4", "4242 -", "45.@+ a1"):
        for _ in range(1500):
            t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 50)))
            assert [s[:3] for s in pii.find_spans(t, automaton) if s[3]] == plain_spans(t)


def test_cue_spans():
    automaton = pii._automaton()
    kinds = lambda t: [s[0] for s in pii.find_spans(t, automaton)]
    assert kinds('token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"') == ["secret"]
    assert kinds("IBAN: GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("IBAN: GB83 WEST 1234 5698 7654 32") == []
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("SSN 000-45-6789") == []
    assert kinds("https://user:pw@host/") == ["url", "login"]
    assert kinds("the token ring and the secret garden") == []


def test_pii_query_rows(spark, docs, tmp_path):
    texts = ["mail é a.b@c.de now", None, "", "1.2.3.4, +1 (555) 555-0100, 4111111111111111", "x" * 200_000 + "@y.z"]
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op4_pii(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        spans = plain_spans(t or "")
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert rows[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[k][f"n_{kind}"] for kind in BASE] == [sum(s[0] == kind for s in spans) for kind in BASE]
    assert rows[0]["spans"] == "email:7:15"
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs(texts)).collect()}
    assert masked[0] == "mail é [email] now" and masked[1] is None and masked[3] == "[ip], [phone], [card]"


# --- tokens ---

def odd_texts():
    random.seed(6)
    pieces = [*"abcXYZ 019'.,!\n\t\r\x0b\x0c\x1c\x85\xa0\u0301 ΣσςİßΑ中🙂가é\u212b\u3000ﬁ", "'s", "'LL", "<|endoftext|>", "e\u0301"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 300))) for _ in range(150)]
    return [*texts, "", " ", "x" * 5000, "ab " * 4000, "é" * 3000, None]


def test_bpe_equals_the_library(docs, monkeypatch):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = odd_texts()
    rows = {r["doc_id"]: r for r in bpe.encode_decode(docs(texts), WORD_BPE).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert rows[k]["ids"] == ids and rows[k]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_repairs_joins_of_tiny_chunks(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", 3)
    tokenizer, encoder = Tokenizer.from_file(WORD_BPE), bpe.Encoder(WORD_BPE)
    texts = [t or "" for t in odd_texts()]
    got = encoder.batch([t.encode() for t in texts]).to_pylist()
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(v is None for v in encoder.chunks.values()) > 10, "some chunks had no white space"


def test_equal_passages_are_cut_alike(monkeypatch):
    monkeypatch.setattr(bpe, "CUT_BITS", 5)
    random.seed(7)
    passage = "".join(random.choice("abcdefgh ") for _ in range(3000)).encode()
    texts = [passage, b"some other beginning " + passage]
    chunks = [{t[x:y] for x, y in zip(e, e[1:])} for t, e in zip(texts, bpe.chunk_edges(texts))]
    assert len(chunks[0] & chunks[1]) > 0.9 * len(chunks[0])


def test_histogram_answers_every_limit(spark, docs):
    texts = [t for t in odd_texts() if t] + ["hello world"] * 3 + [None]
    lengths = token_histogram.token_lengths(docs(texts), RANKS, public_tokenizers.PATTERN)
    plain = [r["n_tokens"] for r in lengths.collect()]
    encode = token_histogram._encoder(RANKS, public_tokenizers.PATTERN).encode_ordinary
    assert sorted(plain) == sorted(len(encode(t or "")) for t in texts)
    histogram = token_histogram.length_histogram(lengths).collect()
    assert len(histogram) == len(set(plain))
    for r in histogram:
        x = r["n_tokens"]
        assert r["n_docs"] == plain.count(x) and r["total_docs"] == len(plain) and r["total_tokens"] == sum(plain)
        assert r["docs_at_least"] == sum(n >= x for n in plain) and r["tokens_at_least"] == sum(n for n in plain if n >= x)
        assert r["truncated_tokens"] == sum(min(n, x) for n in plain)
        assert abs(r["share_within"] - sum(n <= x for n in plain) / len(plain)) < 1e-12
    frame = token_histogram.length_histogram(lengths)
    limits = token_histogram.truncated_totals(frame, [0, 7, 10**6]).collect()
    assert [r["truncated_tokens"] for r in limits] == [sum(min(n, x) for n in plain) for x in (0, 7, 10**6)]
    assert token_histogram.quantile(frame, 0.5).first()[0] == sorted(plain)[(len(plain) + 1) // 2 - 1]
    assert token_histogram.length_histogram(lengths.where("false")).count() == 0


def test_histogram_over_many_blocks(spark):
    lengths = spark.range(5000).selectExpr("id * 3 AS n_tokens")
    rows = token_histogram.length_histogram(lengths).orderBy("n_tokens").collect()
    assert [r["docs_at_least"] for r in rows] == list(range(5000, 0, -1))


@pytest.mark.parametrize("name", ["op3_quality", "op4_pii", "op5_token_histogram", "op6_bpe", "op7_media", "op1_simhash", "op2_mixing", "op8_line_dedup"])
def test_empty_documents(spark, docs, tmp_path, name):
    docs(["x"]).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
