"""Fingerprints against a plain version of the parser, symbol by symbol."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from lineward.llm.phrases import FEW, KEPT, RUN, Parser, edited, fingerprint_documents, likeness

MASK = (1 << 64) - 1
GOLD, NEXT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def mixed(x):
    x &= MASK
    x = ((x ^ (x >> 30)) * NEXT) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def name_of(symbols):
    return mixed(sum(s * pow(GOLD, i, 1 << 64) for i, s in enumerate(symbols)) + len(symbols))


def tossed(names):
    width = 64
    for _ in range(4):
        out = []
        for i, name in enumerate(names):
            left = names[i - 1] if i else ~name & ((1 << width) - 1)
            low = ((name ^ left) & -(name ^ left)).bit_length() - 1
            out.append(2 * low + (name >> low & 1))
        names, width = out, 8
    return names


def level_above(names):
    symbols, i = [], 0
    while i < len(names):
        length = 1
        while length < RUN and i + length < len(names) and names[i + length] == names[i]:
            length += 1
        symbols.append(mixed(names[i] + length * NEXT))
        i += length
    stretches, now = [], []
    for i, s in enumerate(symbols):
        if s in symbols[max(i - 1, 0) : i] + symbols[i + 1 : i + 2]:  # equals a neighbour
            stretches += [now, [s]]
            now = []
        else:
            now.append(s)
    phrases = []
    for stretch in filter(None, [*stretches, now]):
        label = tossed(stretch)
        phrase = []
        for i, s in enumerate(stretch):
            if 0 < i < len(stretch) - 1 and label[i - 1] < label[i] > label[i + 1]:
                phrases.append(phrase)
                phrase = []
            phrase.append(s)
        phrases.append(phrase)
    return [name_of(p) for p in phrases]


def plain_fingerprint(text):
    if not text:
        return bytes(2)
    levels = [[mixed((b + 1) * 0xD6E8FEB86659FD93) for b in text]]
    while len(levels[-1]) >= FEW:
        levels.append(level_above(levels[-1]))
    highest = max([i for i, names in enumerate(levels) if len(names) >= FEW], default=0)
    out = bytes([highest])
    for level in (highest, highest - 1):
        if level < 0:
            continue
        names = levels[level]
        if level == 0:
            names = [mixed(n + (names[i - 1] if i else GOLD) * NEXT) for i, n in enumerate(names)]
        seen, found = {}, []
        for n in names:
            seen[n] = seen.get(n, -1) + 1
            found.append(mixed(n + seen[n] * GOLD) >> 32)
        found = sorted(found)[:KEPT]
        out += bytes([len(found)]) + b"".join(f.to_bytes(4, "big") for f in found)
    return out


PROSE = st.text("abcdefgh  eeaa\nñ日", max_size=900)


@given(st.lists(PROSE | st.text("ab", max_size=400).map(lambda t: t * 3), max_size=6))
@settings(deadline=None, max_examples=60)
def test_fingerprints_equal_the_plain_parser(texts):
    texts = [t.encode() for t in texts]
    assert Parser().fingerprints(texts) == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("text", ["x" * 5000, "one line of it\n" * 700, "ab" * 3000, "aab" * 999 + "c" * 999])
def test_runs_and_repeats_equal_the_plain_parser(text):
    assert Parser().fingerprints([text.encode()]) == [plain_fingerprint(text.encode())]


def test_equal_substrings_share_phrases_at_any_offset():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    parser, shared = Parser(), prose(1500)
    for before in (1, 7, 60, 333):
        a, b = parser.fingerprints([shared.encode(), (prose(before) + " " + shared).encode()])
        assert likeness(a, b) > 0.6
    a, b = parser.fingerprints([prose(1500).encode(), prose(1500).encode()])
    assert likeness(a, b) < 0.15


def test_query_equals_brute_force(spark, sf, documents):
    found = {r["doc_id"]: r for r in queries()["op12_fingerprints"](spark, sf).collect()}
    rows = sorted((d[0], d[1] or "") for d in documents)
    prints = {t: plain_fingerprint(t.encode()).hex() for _, t in rows}
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        n = len(text)
        changed = text[: n - n // 4] + following[: n // 4]
        row = found[doc_id]
        assert (row["n_chars"], row["edited_sha256"]) == (n, sha256(changed.encode()).hexdigest())
        assert row["fingerprint"] == prints[text]
        assert row["near_next"] == likeness(bytes.fromhex(prints[text]), bytes.fromhex(prints[following]))
        assert row["near_edited"] >= 0.5
        if text != following:
            assert row["near_next"] < row["near_edited"]


def test_edited_forms(spark):
    assert edited("abcdefgh", "XYZ") == "abcdefXY" and edited("abcdefgh", "X") == "abcdefX" and edited("abc", "X") == "abc"
    rows = [(None, "no id, but a text"), (2, None), (2, "日本語テキスト"), (1, "only"), (1, "only"), (9, "")]
    found = fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 6
    by_text = {(r["doc_id"], r["n_chars"]): r for r in found}
    assert by_text[9, 0]["fingerprint"] == by_text[2, 0]["fingerprint"] == "0000"
    assert by_text[9, 0]["edited_sha256"] == sha256(b"").hexdigest() and by_text[9, 0]["near_edited"] == 1
    # Null ids come first, so that text is followed by the first of the two with id 1.
    assert by_text[None, 17]["edited_sha256"] == sha256(b"no id, but a only").hexdigest()
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 1}) == 1
    alone = fingerprint_documents(spark.createDataFrame([(5, "abcdefgh" * 40)], "doc_id long, text string")).first()
    assert alone["near_next"] == 1
