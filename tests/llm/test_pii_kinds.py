"""Recall of the added kinds, kind by kind, on sentences that are written without the module's own lists; clean sentences stay clean."""

import random
import string
import time

import pytest

from tidemark.llm import pii

AUTOMATON = pii._automaton()


def spans(text):
    return [(k, text[a:b]) for k, a, b, base in pii.find_spans(text, AUTOMATON) if not base]


def _letters(rng, n, alphabet=string.ascii_letters + string.digits):
    return "1" + "".join(rng.choice(alphabet) for _ in range(n - 1))


def _iban(rng):
    country, bban = rng.choice([("DE", 18), ("FR", 23), ("GB", 18), ("NL", 14)])
    body = "".join(rng.choice(string.digits) for _ in range(bban))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{check:02d}{body}"


def made(rng):
    """``kind, value, sentence`` as people and programs write them."""
    d = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    key, word, host = _letters(rng, rng.randrange(16, 40)), rng.choice(["tiger", "winter", "Blue", "qwerty"]) + d(3), rng.choice(["db.example.org", "10.0.0.7:8080", "shop.example.com"])
    ssn = f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
    grouped = lambda x: " ".join(x[k : k + 4] for k in range(0, len(x), 4))
    iban, user = _iban(rng), rng.choice(["anna", "root", "svc-web"])
    mail = f"{user}@example.net"
    yield from (("secret", key, t.format(key)) for t in (
        "Use api key: {} for the staging server.", "export API_KEY={}", '{{"accessToken": "{}"}}', "Our access key is {} until Friday.", "client_secret = '{}'", "curl -H 'Authorization: Bearer {}' https://x.example", "private key={}",
        "X-Auth-Token: {}", "the encryption key: {} (keep it safe)", "apiKey: \"{}\",",
    ))
    yield from (("secret", word, t.format(word)) for t in ("password: {}", "PASSWORD={}", "My password is {}, do not tell.", "pwd = \"{}\"", "the new passphrase: {}"))
    for form in (f"ghp_{_letters(rng, 36)}", f"xoxb-{d(12)}-{_letters(rng, 16)}", f"sk_live_{_letters(rng, 24)}", f"AKIA{_letters(rng, 16, string.ascii_uppercase + string.digits)}", f"eyJ{_letters(rng, 20)}.{_letters(rng, 40)}.{_letters(rng, 43)}", f"glpat-{_letters(rng, 20)}"):
        yield "secret", form, f"We found {form} in the log."
    number = d(rng.randrange(8, 13))
    yield from (("account", number, t.format(number)) for t in ("account number {}", "Account No.: {}", "Please pay to account number: {}, thank you.", "acct # {}", "bank account {} at the branch", "A/C no {}"))
    code = f"{d(2)}-{d(2)}-{d(2)}"
    yield from (("account", code, t.format(code)) for t in ("sort code {}", "Sort Code: {}."))
    yield from (("iban", v, t.format(v)) for v in (iban, grouped(iban)) for t in ("IBAN {}", "IBAN: {}.", "my iban is no. {} at the bank".replace(" is", "")))
    yield from (("ssn", ssn, t.format(ssn)) for t in ("SSN {}", "SSN: {}", "social security number {}", "His Social Security no. is {}."))
    login = f"{user}:{word}"
    yield from (("login", login, t.format(login, host)) for t in ("postgres://{}@{}/main", "see https://{}@{}", "git clone ftp://{}@{}/x.git now"))
    for address in (f"https://{login}@{host}/a?b=1", f"http://{host}/reset?token={key}", f"https://{host}/u?id=3&email={mail}#top", f"redis://{login}@{host}"):
        yield from (("url", address, t.format(address)) for t in ("Open {} today.", "({})", "link: <{}>", "\"{}\", they said"))


def test_recall_of_each_kind():
    rng, found, total = random.Random(3), {}, {}
    for _ in range(200):
        for kind, value, sentence in made(rng):
            total[kind] = total.get(kind, 0) + 1
            hit = (kind, value) in spans(f"Before that. {sentence} And more.")
            found[kind] = found.get(kind, 0) + hit
    recall = {k: round(found[k] / n, 3) for k, n in total.items()}
    print(recall)
    assert set(total) == set(pii.KINDS) - set(pii.BASE_KINDS) and min(recall.values()) >= 0.9, recall


@pytest.mark.parametrize("text", [
    "The password is incorrect.", "Bearer of bad news and bearers of gifts", "an account of 1848 and the year 1849", "We account for 12 of them", "the key is under the mat", "A token of thanks: none",
    "https://example.org/a?page=3&q=key", "See http://example.org/path (or not).", "https://ex ample/?token=1", "http://host:99999/?token=abc", "ratio://", "://", "a://?token=x", "secret garden 1911", "sort code of honour",
    "Akiander was here", "eyJust kidding.a.b", "-----BEGIN CERTIFICATE-----", "acct", "bearer", "The API key concepts: 12 lessons",
])
def test_clean_sentences(text):
    assert spans(text) == []


def test_address_boundaries():
    find = lambda t: [v for k, v in spans(t) if k == "url"]
    a = "https://u:p1@example.org/x_(y)?z=1"
    assert find(f"({a}), then {a}. [{a}] '{a}'!") == [a] * 4
    assert find(f"x{a}") == ["x" + a] and find(f"1+{a}") == [a] and find("http://[::1]:80/?sid=7 é") == ["http://[::1]:80/?sid=7"]


@pytest.mark.parametrize("text", ["account number " * 20_000, "bearer " * 40_000, "a://b@" * 40_000, "eyJ" * 60_000, "account number " + "1-" * 100_000, "http://x?" + "token=" * 50_000, "bearer " + "a" * 300_000, "://" * 80_000, "acct" + ": " * 100_000, "-----BEGIN " * 20_000])
def test_time_follows_the_text(text):
    began = time.time()
    pii.find_spans(text, AUTOMATON)
    assert time.time() - began < 5
