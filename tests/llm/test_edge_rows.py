"""Edge rows of operators: ids of any type, clashing names, null ids, long texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_ops import plain_repeats
from tidemark.llm import lines, mixing, pii, repetition, simhash, token_histogram


def clashing(table):
    for name in ("keep", "src", "parts", "cdf", "n", "cut", "text_hash", "doc", "key", "__keep", "node", "kept", "spans", "ids"):
        table = table.withColumn(name, F.lit("clash"))
    return table


def test_string_ids_and_clashing_names(docs):
    table = clashing(docs(["a b c d e f", "a b c d e f", "x y z", None, ""]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))))
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table).collect()} == {"d0": "d0", "d1": "d0", "d2": "d2", "d3": "d3", "d4": "d3"}
    for options in ({}, {"similarity": 0.8}):
        kept = simhash.keep_one_per_group(table, **options)
        assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == ["d0", "d2", "d3"]
    assert mixing.mix(table).columns == [*table.columns, "replica", "order_key"] and mixing.mix(table).count() > 0
    cut = lines.dedup_lines(table, 1, keep_first=False)
    assert cut.columns == [*table.columns, "n_lines", "n_removed"] and {r["text"] for r in cut.collect()} == {"", None}
    assert pii.find_pii(table).columns == ["doc_id", "spans"] and pii.find_pii(table).count() == 5
    odd = table.drop("kept").withColumnRenamed("doc_id", "kept")
    assert repetition.score_quality(odd, id_col="kept").columns[0] == "kept" and repetition.score_quality(odd, id_col="kept").where("NOT kept_").count() == 5


def test_null_ids(docs):
    table = docs(["same line\nown %d" % k for k in range(6)], [*"abcdef"], ids=[None] * 6)
    assert [r["n_removed"] for r in lines.dedup_lines(table).collect()] == [1] * 6
    many = docs([f"text {k}" for k in range(400)], ids=[None] * 400)
    drawn = mixing.mix(many).count()
    assert 300 < drawn < 500, "null ids are drawn one by one"


def test_long_repetitive_text_keeps_memory(monkeypatch):
    import tracemalloc

    text = " ".join(random.Random(3).choices(["a", "b", "c"], k=40)) + " "
    tracemalloc.start()
    found = repetition.measure([text * 10_000])
    assert tracemalloc.get_traced_memory()[1] < 300 * 400_000 and found["longest_repeat"][0] == 40 * 9_999
    tracemalloc.stop()
    monkeypatch.setattr(repetition, "KEPT_RANKS", 0)
    rng = random.Random(4)
    for k in range(60):
        t = " ".join(rng.choice("abcdef"[: 1 + k % 6]) for _ in range(rng.randint(0, 90)))
        found = repetition.measure([t])
        assert (found["n_repeat_words"][0], found["n_covered_words"][0], found["longest_repeat"][0]) == plain_repeats(t)


def test_long_unbroken_text_has_its_length(docs):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["a" * 200_000, "ab" * 50_000, " " * 100_000, "", None]
    got = {r["doc_id"]: r["n_tokens"] for r in token_histogram.token_lengths(docs(texts), path, public_tokenizers.PATTERN).collect()}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert [got[k] for k in range(5)] == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]


# --- added kinds of personal data ---

def spans_of(text, kind):
    return [text[a:b] for k, a, b, _ in pii.find_spans(text, pii._automaton()) if k == kind]


@pytest.mark.parametrize("text, want", [
    ('apiKey = "abcd1234efgh5678"', "abcd1234efgh5678"), ("accessKey: AKIA1234567890ABCD", "AKIA1234567890ABCD"), ("ApiKey=a1b2c3d4e5f6g7", "a1b2c3d4e5f6g7"),
    ("PassWord: s3cret!pass", "s3cret!pass"), ("password=hunter2", "hunter2"), ("password=opensesame", "opensesame"), ('pwd: "correct-horse"', "correct-horse"),
    ('{"client_secret": "abc123def"}', "abc123def"), ("MY_LONG_PREFIX_TOKEN_FOR_THIS_SERVICE_NAME_X := 0123456789abcdef", "0123456789abcdef"), ("AUTH_KEY='0a1b2c3d'", "0a1b2c3d"),
    *((f"token={'x7' * n}", "x7" * n) for n in (6, 150, 5_000)), ("db_password = 'p4$$word but not this'", "p4$$word"), ("PASSPHRASE => blue42horse", "blue42horse"),
])
def test_secrets_of_any_spelling_and_length(text, want):
    assert spans_of(f"x {text} y", "secret") == [want]


@pytest.mark.parametrize("text", ["the token of love", "password: required", "secretary: Mrs. Jones", "a secret: nobody knew", "token: see-the-manual-page", "pwd: abc", "passwords are hard", "key=1234567890123456"])
def test_prose_has_no_secrets(text):
    assert spans_of(text, "secret") == []


@pytest.mark.parametrize("text, kind, want", [
    ("https://me:pw@host/x", "login", "me:pw"), (f"ftp://{'u' * 300}:{'p' * 10_000}@h", "login", "u" * 300 + ":" + "p" * 10_000), ("ssh://git@host", "login", "git"),
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "iban", "DE89 3704 0044 0532 0130 00"), ("iban no. GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
    ("IBAN:" + " " * 40 + "GB82WEST12345698765432", "iban", "GB82WEST12345698765432"), ("Social Security number is known to be 123-45-6789.", "ssn", "123-45-6789"), ("SSN ssn 078-05-1120", "ssn", "078-05-1120"),
])
def test_logins_and_accounts(text, kind, want):
    assert spans_of(text, kind) == [want]


@pytest.mark.parametrize("text", ["https://medium.com/@me", "IBAN GB82WEST12345698765433", "ssn 666-45-6789", "ssn 123-45-67890", "ssn\n123-45-6789", "https://h/a?b=c"])
def test_no_logins_or_accounts(text):
    assert not {k for k, *_ in pii.find_spans(text, pii._automaton())} - set(pii.BASE_KINDS)


def test_recall_and_precision_of_added_kinds():
    rng = random.Random(11)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    make = lambda n: "".join(rng.choices(alnum, k=n - 1)) + rng.choice("0123456789")

    def spelled(words):
        style = rng.randrange(5)
        if style < 2:
            return ("_-"[style]).join(words).upper() if rng.random() < 0.5 else ("_-"[style]).join(words)
        return {2: words[0] + "".join(w.title() for w in words[1:]), 3: "".join(w.title() for w in words), 4: "".join(words)}[style]

    found = total = wrong = 0
    for _ in range(2000):
        cue = rng.choice([["api", "key"], ["access", "key"], ["private", "key"], ["auth", "key"], ["client", "secret"], ["access", "token"], ["token"], ["password"], ["db", "password"], ["passwd"]])
        value, quote, sign = make(rng.choice([12, 20, 40, 400])), rng.choice(["", '"', "'"]), rng.choice([" = ", "=", ": ", ":", " := ", " => "])
        text = f"some words {spelled(cue)}{sign}{quote}{value}{quote} and more"
        total += 1
        hits = spans_of(text, "secret")
        found += value in hits
        wrong += any(h != value for h in hits)
    assert found >= 0.97 * total and wrong <= 0.01 * total, (found, wrong, total)


def plain_secrets(text):
    """Every cue at every place, tried on its own; values inside others dropped."""
    name = r"[A-Za-z0-9_-]*+[\"']?[ ]?(:=|=>|=|:)[ ]?([\"']?)"
    out = []
    for m in re.finditer("(?=(" + "|".join(sorted(pii.PASSWORD_CUES + pii.SECRET_CUES, key=len, reverse=True)) + "))", text.lower()):
        for cue in pii.PASSWORD_CUES + pii.SECRET_CUES:
            at = m.start()
            if not text.lower().startswith(cue, at) or not (n := re.compile(name).match(text, at + len(cue))):
                continue
            password = cue in pii.PASSWORD_CUES
            chars = ("[^\\s\"']+" if n[2] else "[^\\s\"'<>&;,]+") if password else "[A-Za-z0-9_./+=~-]+"
            v = re.compile(chars).match(text, n.end())
            if v and len(v[0]) >= (6 if password else 8 if n[2] else 12) and (re.search("[0-9]", v[0]) or password and (n[2] or n[1] == "=")):
                out.append((at, v.start(), v.end()))
    kept, end = [], 0
    for at, a, b in sorted(set(out)):
        if at >= end:
            kept.append((a, b))
            end = b
    return sorted(set(kept))


def test_secrets_equal_brute_force():
    rng = random.Random(12)
    pieces = ["token", "Secret", "apiKey", "PASSWORD", "pwd", "access_key", "_", "-", "=", ":", ":=", "=>", " ", " ", '"', "'", "abc123def456", "0123456789", "letters", "x", "&", "\n", "@", "://"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        got = sorted((a, b) for k, a, b, _ in pii.find_spans(text, pii._automaton()) if k == "secret")
        assert got == plain_secrets(text), text


@pytest.mark.parametrize("unit", ["token", "token=", "password=", "ssn ", "iban ", "://", "a@", "1-", "+1 ", "1.", "secret_", "pwd:"])
def test_work_follows_the_text(unit):
    import time

    def seconds(n):
        began = time.time()
        pii.find_spans(unit * (n // len(unit)), pii._automaton())
        return time.time() - began

    assert seconds(10_000) < 2 and seconds(160_000) < 2
