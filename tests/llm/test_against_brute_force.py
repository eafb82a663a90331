"""The registered queries on a small data folder against plain Python, the library, or held-out labels."""

import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from lineward.llm.decontaminate import leaks
from lineward.llm.html_extract import main_text
from lineward.llm.sentencepieces import ChunkCache, MergeVocabulary, encode_texts
from lineward.llm.sharding import Runs

WORD = re.compile("[^\x20\x09-\x0d]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    return (text or "").encode().lower().split()


def rows_of(spark, sf, name):
    return {r[0]: r for r in queries()[name](spark, sf).collect()}


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_html_extraction(spark, sf):
    found = rows_of(spark, sf, "op1_html_extraction")
    for page in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)
        parts = re.split(r"</?(?:p|h1)>", article.group(1).replace("<br>", " ") if article else "")
        texts = (" ".join(html.unescape(re.sub("<[^>]*(>|$)", "", p)).split()) for p in parts)
        want = "\n".join(t for t in texts if t)
        assert (found[page["page_id"]]["text"], found[page["page_id"]]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div id=main><h1>T</h1><p>One, two,\n three &lt; four</p></div><div class=sidebar><p>a, b, c</p></div>", "T\nOne, two, three < four"),
        ("<ul class='site-menu'><li><a href=/>Home</a></ul><p>Body, text here.</p>", "Body, text here."),
        ("<article><p>Body, of it</p><ul><li>x</li><li>y</li></ul><form>no</form></article><div id='comments'><p>Long, long, comment</p></div>", "Body, of it\nx\ny"),
        ("<main><p>a<b>b</b>c <a href=x>link</a></p><aside>no</aside><!-- <p>no</p> --></main><footer>no</footer>", "abc link"),
        ("<div class='cookie-notice'><p>We, use, cookies</p></div><table><tr><td>cell</td></tr></table>", "cell"),
        ("no markup &amp; more", "no markup & more"),
        ("<article><p>Of it, all</p></article><section class=c><article class='comment-body'><p>Long, long comment, longer than all of it</p></article></section>", "Of it, all"),
        ("<div class='content no-sidebar'><p>The text, all of it</p></div><div class=widget>x</div>", "The text, all of it"),
        ("<p>cut off <a href='x", "cut off"),
    ],
)
def test_html_by_hand(page, want):
    assert main_text(page) == want


def test_sharding(spark, sf, documents):
    found = rows_of(spark, sf, "op2_sharding")
    groups, slots = defaultdict(int), defaultdict(list)
    for doc_id, text, *_ in documents:
        data = (text or "").encode()
        row = found[doc_id]
        assert (row["size"], row["text_crc32"], row["law"]) == (len(data) + 8, zlib.crc32(data), "bytes")
        groups[md5(data).hexdigest()] += len(data) + 8
        slots[row["shard"]].append(row["slot"])
        assert row["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = {}
    for doc_id, text, *_ in documents:
        key = md5((text or "").encode()).hexdigest()
        assert shard_of.setdefault(key, found[doc_id]["shard"]) == found[doc_id]["shard"]
    sizes = [groups[k] for k in sorted(groups)]

    def shards_for(capacity):
        n, room = 1, capacity
        for size in sizes:
            if size > room:
                n, room = n + 1, capacity
            room -= size
        return n

    filled = Counter()
    for key, size in groups.items():
        filled[shard_of[key]] += size
    least = max(sizes)
    while shards_for(least) > 24:
        least += 1
    assert max(filled.values()) == least
    assert [shard_of[k] for k in sorted(groups)] == sorted(shard_of.values())


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_least_capacity_and_even_cuts(sizes, shards):
    runs = Runs([(f"{i:04d}", n, True) for i, n in enumerate(sizes)])
    least = runs.least(shards, True)
    ends, split = runs.even_cuts(least, shards)
    assert not split and ends[-1] == sum(sizes)
    assert max(b - a for a, b in zip([0, *ends], ends)) <= least
    assert runs.cuts(least - 1, shards, True)[-1] < sum(sizes) or least == 1


def test_language_model(spark, sf, documents):
    found = rows_of(spark, sf, "op3_language_model")
    counts = Counter()
    for doc_id, text, *_ in documents:
        if remainder(doc_id, 10):
            counts.update([*words(text), None])
    total, kinds = sum(counts.values()), len(counts)
    better = []
    for doc_id, text, *_ in documents:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in tokens)
        row = found[doc_id]
        assert row["held_out"] == (remainder(doc_id, 10) == 0)
        assert (row["n_tokens"], row["train_tokens"]) == (len(tokens), total)
        assert row["n_known"] == sum(counts[t] > 0 for t in tokens)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] < 0
        better.append(row["score"] >= row["base_score"])
    assert sum(better) > 0.9 * len(better)


def test_language_id(spark, sf, documents):
    found = rows_of(spark, sf, "op4_language_id")
    held = [(found[d]["lang_pred"], lang) for d, _, lang, _ in documents if found[d]["held_out"]]
    assert all(found[d]["held_out"] == (remainder(d, 4) == 2) for d, *_ in documents)
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_sentencepiece(spark, sf, documents):
    found = rows_of(spark, sf, "op5_sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for doc_id, text, *_ in documents:
        ids = library.encode(text or "")
        row = found[doc_id]
        assert row["n_tokens"] == len(ids) and row["n_corrected"] == 0
        assert row["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == sha256(library.decode(ids).encode()).hexdigest()


CACHE = ChunkCache(MergeVocabulary(open(MODEL, "rb").read()))
ODD = st.one_of(st.sampled_from(" ▁\n\t\x00ab<s>0xthe.,²"), st.characters(blacklist_categories=["Cs"]))


@given(st.text(alphabet=ODD, max_size=60))
@settings(max_examples=500, deadline=None)
def test_agenda_equals_library(text):
    ids, decoded, corrected = encode_texts(CACHE, [text])[0]
    want = CACHE.vocabulary.library.encode(text)
    assert ids == ",".join(map(str, want)) and not corrected
    assert decoded == CACHE.vocabulary.library.decode(want)


@given(st.text(alphabet="the inagro▁", min_size=1, max_size=120))
@settings(max_examples=200, deadline=None)
def test_both_agendas_agree(text):
    vocabulary = CACHE.vocabulary
    assert vocabulary._merge_few(text) == vocabulary._merge_many(text)


def test_quality_classifier(spark, sf):
    found = rows_of(spark, sf, "op6_quality_classifier")
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    poor = [not found[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    good = [found[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    assert sum(poor) >= 0.9 * len(poor) and sum(good) >= 0.95 * len(good)


def test_quality_rules(spark, sf, documents):
    found = rows_of(spark, sf, "op7_quality_rules")
    for doc_id, text, *_ in documents:
        own = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        windows = defaultdict(list)
        for i in range(len(own) - 7):
            windows[tuple(own[i : i + 8])].append(i)
        again = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        row = found[doc_id]
        assert row["n_words"] == len(own) and row["word_chars"] == sum(map(len, own))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(again)
        assert row["base_failed"] == (len(own) < 20 or 100 * len(again) > 30 * len(own))
        assert row["kept"] == (not row["base_failed"] and not row["depleted"])


def test_frequent_lines_deplete(spark):
    from lineward.llm.quality_rules import quality_rules

    line = "all rights of this host are reserved by those who wrote it"
    def name(i, j):
        return "".join(chr(97 + n) for n in (i // 26, i % 26, j // 26, j % 26))

    own = [" ".join(name(i, j) for j in range(30)) for i in range(60)]
    rows = [(i, f"{line}\n{own[i]}", "a") for i in range(60)]
    rows += [(100, f"{line}\n{line.upper()}\nfew more", "a"), (101, f"{line}\n{line}\nfew more", "b")]
    copy = "\n".join(" ".join(name(100 + k, j) for j in range(10)) for k in range(4))
    rows += [(200 + i, copy, "a") for i in range(50)]
    found = {r[0]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i]["kept"] and found[i]["removed_words"] == 12 for i in range(60))
    assert found[100]["depleted"] and not found[101]["depleted"]
    assert all(found[200 + i]["kept"] for i in range(50))


def test_boilerplate_is_told_from_near_copies(spark):
    from lineward.llm.quality_rules import quality_rules

    rng = random.Random(3)

    def line(n):
        return [f"{''.join(rng.choices('abcdefghijkl', k=7))}" for _ in range(n)]

    shared = "\n".join(" ".join(line(10)) for _ in range(10))
    heavy = [(i, f"{shared}\n{' '.join(line(15))}", "heavy") for i in range(100)]
    base = [line(12) for _ in range(12)]
    near = []
    for i in range(3000):
        copy = [list(x) for x in base]
        for _ in range(3):
            copy[rng.randrange(12)][rng.randrange(12)] = line(1)[0]
        near.append((1000 + i, "\n".join(map(" ".join, copy)), "near"))
    rows = spark.createDataFrame(heavy + near, "doc_id long, text string, source string")
    found = {r[0]: r for r in quality_rules(rows).collect()}
    assert all(found[i]["removed_words"] == 100 and found[i]["depleted"] for i, *_ in heavy)
    assert all(found[i]["removed_words"] == 0 and found[i]["kept"] for i, *_ in near)


def test_decontamination(spark, sf, documents):
    found = rows_of(spark, sf, "op8_decontamination")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for doc_id, text, *_ in documents:
        assert found[doc_id]["contaminated"] == any(i in text for i in items) == (not found[doc_id]["kept"])


def test_other_parameters(spark):
    item = "If Anna buys 12 red apples for 3.50 euros and Anna gives 12 of them away, what does each apple of Anna cost in total now"
    other = "Question: If Bernd buys 40 red apples for 7 dollars and Bernd gives 40 of them away, what does each apple of Bernd cost in total now?"
    form = "Question: If Bernd buys 40 red apples for 7 dollars and Carla gives 90 of them away, what does each apple of Doris cost in total now?"
    docs = spark.createDataFrame([(1, other), (2, form), (3, item), (4, "nothing of that kind here")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert set(found) == {1, 3}
    assert found[1]["other_parameters"] and not found[3]["other_parameters"]


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    found = rows_of(spark, sf, "op9_toxicity")
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r["doc_id"]]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert sum(found[r["doc_id"]]["predicted"] == r["toxic"] for r in labels) >= 0.93 * len(labels)
    toxic = [found[r["doc_id"]]["score"] for r in labels if r["toxic"]]
    other = [found[r["doc_id"]]["score"] for r in labels if not r["toxic"]]
    assert sum(toxic) / len(toxic) > 3 * sum(other) / len(other)


def shingles(text, size):
    own = words(text)
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} or ({tuple(own)} if own else set())


def brute_components(texts, size):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        common = Counter(j for x in s for j in having[x] if j > i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_minhash(spark, sf, documents):
    found = rows_of(spark, sf, "op10_minhash")
    want = brute_components({d: t for d, t, *_ in documents}, 2)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_minhash_of_a_large_group(spark):
    import random

    from lineward.llm.minhash import near_duplicates

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = {}
    for i in range(700):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(60)] = rng.choice(vocabulary)
        texts[i] = " ".join(own)
    for i in range(700, 900):
        texts[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, 2, 80).collect()}
    assert found == brute_components(texts, 2)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == before
    want = sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())
    assert sorted(tuple(r) for r in queries()["pipeline"](spark, sf).collect()) == want
