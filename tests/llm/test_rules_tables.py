"""What the quality rules write on the way, and how the bands of near duplicates meet."""

from lineward.llm import minhash, quality_rules
from lineward.llm.common import TEXT_ROWS


def test_held_lines_come_in_few_rows(spark, monkeypatch):
    asked = {}
    written = quality_rules.written

    def watched(df, name, batch_rows=None, **more):
        asked[name] = (batch_rows, more.get("compression"))
        return written(df, name, batch_rows, **more)

    monkeypatch.setattr(quality_rules, "written", watched)
    own = "alpha beta gamma delta epsilon zeta {0} eta{0} theta{0} iota{0} kappa{0} lambda{0}"
    docs = spark.createDataFrame(
        [(i, f"all rights of this page are reserved\n{own.format(i)}", "host") for i in range(25)],
        "doc_id long, text string, source string",
    )
    rows = quality_rules.quality_rules(docs).collect()
    assert {r["removed_words"] for r in rows} == {7}
    assert asked["held-lines"] == (TEXT_ROWS, "zstd")
    assert asked["known-by"][1] == "zstd"


def test_bands_of_one_block_meet_without_a_join(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(12)], "doc_id long, text string")
    sketched = minhash.written(minhash.sketch_documents(docs, 1), "sketches")
    members = sketched.selectExpr("doc_id doc", "explode(bands) key", "doc_id component")
    found = {}
    for size in (256, 4):
        monkeypatch.setattr(minhash, "BLOCK_ROWS", size)
        pairs = minhash._mixed_pairs(members, sketched, docs, 1, 80)
        found[size] = sorted(map(tuple, pairs.distinct().collect()))
    assert found[256] == found[4] == [(a, b) for a in range(12) for b in range(a + 1, 12)]
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 256)
    kept = []
    written = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name, *more: kept.append((name, df.columns)) or written(df, name, *more))
    minhash._mixed_pairs(members, sketched, docs, 1, 80)
    assert "n_blocks" in dict(kept)["blocks"]


def _watched(monkeypatch, module):
    """The rows of the tables that ``module`` writes from now on, by name."""
    found, written = {}, module.written

    def watched(df, name, *some, **more):
        table = written(df, name, *some, **more)
        found[name] = table.collect()
        return table

    monkeypatch.setattr(module, "written", watched)
    return found


def test_only_recurring_lines_meet_their_documents(spark, monkeypatch):
    tables = _watched(monkeypatch, quality_rules)
    spread = [("a", 1, i) for i in range(5)] + [("a", 2, 7)] * 5 + [("b", 1, i) for i in range(3)]
    spread += [("a", 100 + i, i) for i in range(50)]
    occurring = spark.createDataFrame(spread, "host string, line long, content long")
    often = quality_rules._often(occurring, 3)
    assert sorted(map(tuple, often.collect())) == sorted(s for s in spread if s[0] == "a" and s[1] < 3)
    assert len(tables["recurring"]) == 2
    named = quality_rules._above(often, "content", 3, "candidates")
    assert [tuple(r) for r in named.collect()] == [("a", 1, 5)]


def test_lines_that_share_nothing_are_not_grouped(spark, monkeypatch):
    tables = _watched(monkeypatch, quality_rules)
    own = "alpha{0} beta{0} gamma{0} delta{0} epsilon{0} zeta{0} eta{0}"
    rows = [(i, f"all rights of this page are reserved\n{own.format(i)}", "h") for i in range(25)]
    # A variant shares 2 of its 6 shingles with the candidate; the line below it none.
    rows += [(50, f"all rights of this page are reserved\nall rights of this other place gone away\n{own.format('x')}", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["removed_words"] for r in quality_rules.quality_rules(docs).collect()}
    assert set(found.values()) == {7}
    variants = tables["variants"]
    assert [r["v_place"] for r in variants] == [1]
    words = {r["o_row"]: r["own_words"] for r in tables["own-lines"]}
    assert words[variants[0]["v_row"]] == 7 and set(words.values()) == {7}


def test_only_documents_with_a_common_band_are_compared(spark, monkeypatch):
    tables = _watched(monkeypatch, minhash)
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(i, f"{near} x{i}") for i in range(4)] + [(100 + i, " ".join(f"o{i}n{j}" for j in range(60))) for i in range(30)]
    rows += [(200, near + " x1"), (1, near + " x1"), (None, near + " x2"), (300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs, 1, 80).collect()}
    want = {(i, 0) for i in (0, 1, 2, 3, 200, None)} | {(100 + i, 100 + i) for i in range(30)} | {(300, 300)}
    assert found == want
    assert {r["doc_id"] for r in tables["compared"]} == {0, 1, 2, 3}
    assert set(tables["reps"][0].asDict()) == {"doc_id", "bands"}


def test_values_that_a_line_repeats_are_looked_up_once(spark, monkeypatch):
    tables = _watched(monkeypatch, quality_rules)
    own = "alpha{0} beta{0} gamma{0} delta{0} epsilon{0} zeta{0} eta{0}"
    rows = [(i, f"tick tock tick tock\n{own.format(i)}", "h") for i in range(25)]
    many, other = " ".join(["tick tock"] * 200), " ".join(f"word{i}" for i in range(20))
    # 6 of 26 shingles are the candidate's, but only 2 of the 22 distinct ones; then 2 of 24, and 398 of 398.
    rows += [(50, f"tick tock tick tock\ntick tock tick tock tick tock tick tock {other}\n{own.format('x')}", "h")]
    rows += [(51, f"tick tock tick tock\ntick tock tick tock {other} gone away\n{own.format('y')}", "h")]
    rows += [(52, f"tick tock tick tock\n{many}\n{own.format('z')}", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["removed_words"] for r in quality_rules.quality_rules(docs).collect()}
    assert set(found.values()) == {4}
    words = sorted(r["own_words"] for r in tables["own-lines"])
    assert words == [7] * 27 + [33]  # the line of document 51 is no variant
    assert len(tables["variants"]) == 2
    assert max(len(near) - len(set(near)) for r in tables["held-lines"] for near in r["near"]) == 0
    held = [(len(near), sum(times)) for r in tables["held-lines"] for near, times in zip(r["near"], r["times"])]
    assert held.count((2, 398)) == 1
