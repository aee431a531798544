import hashlib
import random

import pytest

from sparkloom.llm import secret_scan as s
from sparkloom.llm.tokens import DEFAULT_VOCABULARY as V

RNG = random.Random(9)
KEYS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)) for n in (24, 32, 40, 44)]
HEX = "".join(RNG.choice("0123456789abcdef") for _ in range(40))


@pytest.mark.parametrize("text", [f"key {k} end" for k in KEYS] + [f'token = "{HEX}"', f"API_KEY={KEYS[1]}"])
def test_random_strings_are_found(text):
    found = s.findings(text, V, s.MAX_RATIO)
    assert len(found) == 1 and len(text[found[0][0] : found[0][1]]) >= 20


@pytest.mark.parametrize(
    "text",
    [
        "plain words only",
        f"commit {HEX} fixes it",
        "id 123e4567-e89b-12d3-a456-426614174000 there",
        "call 555-123-4567-8901-2345-6789",
        "see release-notes-for-version-2024-06 now",
        "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=",
        "einheitverberbeeinheitkeiterer9 wort",
        "",
        None,
    ],
)
def test_other_strings_are_not(text):
    assert s.findings(text, V, s.MAX_RATIO) == []


LETTERS = "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(32))
PASSWORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24)) for _ in range(200)]


@pytest.mark.parametrize("key", [LETTERS, KEYS[1][:16], LETTERS[:16]])
def test_letters_and_shorter_keys_are_found(key):
    assert [f[:2] for f in s.findings(f"key {key} end", V, s.MAX_RATIO)] == [(4, 4 + len(key))]


def test_keys_joined_to_names_are_found():
    for name in ("database_connection_password=", "https://internationalization/understanding/", "international_understanding_documentation_"):
        for p in PASSWORDS:
            found = s.findings(name + p, V, s.MAX_RATIO)
            assert len(found) == 1 and found[0][1] == len(name + p) and found[0][0] <= len(name), name + p


@pytest.mark.parametrize("text", ["Nichtschkeitauau", "getElementsByTagName", "src/main/java/com/example/RequestHandler", "======Overview======"])
def test_words_of_letters_are_not_keys(text):
    assert s.findings(text, V, s.MAX_RATIO) == []


def test_the_name_before_a_value_may_be_far_and_long():
    for between in (' = "', ":\n", "' => '", " " * 300, " " * 90 + "=" + "\n" * 90, "_of_the_" + "very_" * 100 + "old_server="):
        assert len(s.findings(f"the token{between}{HEX} end", V, s.MAX_RATIO)) == 1, between
    for between in (" is ", "; ", " = = ", ""):
        assert s.findings(f"the token{between}\n.{HEX} end", V, s.MAX_RATIO) == [], between


def test_known_strings_are_passed_over():
    digest = hashlib.sha256(KEYS[2].encode()).hexdigest()
    assert s.findings(KEYS[2], V, s.MAX_RATIO, frozenset([digest])) == []


def brute(text):
    """Every run of key characters, tried one after the other."""
    out, at = [], 0
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    while at < len(text):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        run = text[at:end]
        if len(run) >= s.MIN_LENGTH and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            if s._excluded(text, at, run, frozenset()) is None and len(run) <= s.MAX_RATIO * s.coder(V).count(run):
                out.append((at, end))
        at = max(end, at + 1)
    return out


def test_scan_and_redaction_of_a_table(spark):
    mixed = f"a {KEYS[0]} b {KEYS[3]}, {HEX} token: {HEX}."
    rows = [(1, mixed, 3), (2, "clean", 5), (3, None, 0), (4, "", 0), (None, KEYS[1], 32), (1, mixed, 3), (5, "word " * 100_000 + KEYS[0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars long, start string")
    got = sorted(((str(r.doc_id), r.start, r.start + r.length) for r in s.scan(df).collect()))
    assert got == sorted((str(i), a, b) for i, t, *_ in rows for a, b in brute(t or ""))
    out = s.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == f"a {s.MARK} b {s.MARK}, {HEX} token: {s.MARK}." and by[1].n_chars == len(by[1].text)
    assert by[2].text == "clean" and by[3].text is None and by[4].text == ""
    assert s.scan(df.limit(0)).count() == 0 and s.redact(df.limit(0)).count() == 0
