"""Arrow functions over files hold a few files at a time, however many rows Spark sends at once."""

import tracemalloc

import pyarrow as pa

from lineward.functions.sniff import _office_kind
from lineward.sources.files import _fallback_text
from lineward.sources.office import _office_text, _zip_flags
from registry import derived

ROWS, CHARS = 4000, 2000
LIMIT = 8 << 20  # the batch has 8 MB of text, so that whole copies of it pass this


def documents(ids):
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": ids,
            "n_chars": [CHARS + i % 3 for i in ids],
            "source": ["s"] * len(ids),
            "text": [f"{i} line\n" + "x" * CHARS for i in ids],
        }
    )


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def drained(batches):
    return [b.column("doc_id").to_pylist() for b in batches]


def test_writers_hold_pieces():
    batch = documents(list(range(ROWS)))
    for write in (derived._zip_batches, derived._office_batches, derived._encoded_batches):
        assert peak(lambda: list(map(len, drained(write(iter([batch])))))) < LIMIT, write
        assert sum(drained(write(iter([batch]))), []) == list(range(ROWS))


def test_readers_hold_pieces():
    content = derived.docx_bytes(["x" * CHARS])
    files = pa.array([content, None] * (ROWS // 2), pa.binary())
    kinds = pa.array(["docx", None] * (ROWS // 2))
    broken = pa.array([b"\xff" + b"x" * CHARS, None] * (ROWS // 2), pa.binary())
    found = {}
    works = {
        "kind": lambda: _office_kind.func(files),
        "flags": lambda: _zip_flags.func(files),
        "text": lambda: _office_text.func(kinds, files),
        "decoded": lambda: _fallback_text.func(broken),
    }
    for name, work in works.items():
        assert peak(lambda: found.update({name: work()})) < LIMIT // 2, name
    assert found["kind"].to_pylist()[:2] == ["docx", None]
    assert found["flags"].to_pylist()[:2] == [{"is_encrypted": False, "is_pseudo": False}] * 2
    assert found["text"].to_pylist() == ["x" * CHARS, None] * (ROWS // 2)
    assert found["decoded"].to_pylist() == ["x" * CHARS, None] * (ROWS // 2)
