import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import common


@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 12))
def test_slide(values, width):
    a = np.array(values, np.uint64)
    want = [min(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert common.slide(a, width, np.minimum).tolist() == want


@settings(max_examples=200)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=60), st.integers(1, 9))
def test_anchors_of_equal_windows_are_equal(values, width):
    """Each window has one, and where two windows are equal they are too."""
    a = np.array(values, np.uint64)
    at = set(common.anchors(a, np.ones(max(0, len(a) - width + 1), bool), width).tolist())
    seen = {}
    for s in range(len(values) - width + 1):
        w = tuple(values[s : s + width])
        own = {k for k in range(width) if values[s + k] == min(w)}
        assert own and all(s + k in at for k in own)
        assert seen.setdefault(w, own) == own


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 3)), max_size=50))
def test_multikey_order(rows):
    columns = [np.array([r[i] for r in rows], np.int64) for i in range(3)]
    order = common.multikey_order(columns)
    assert [rows[i] for i in order] == sorted(rows)


@given(st.sets(st.integers(0, 60)), st.integers(1, 9))
def test_union_length(starts, length):
    covered = {s + k for s in starts for k in range(length)}
    runs = common.union_length(np.array(sorted(starts), np.int64), length)
    assert {p for a, z in runs.tolist() for p in range(a, z)} == covered
    assert all(z < a for (_, z), (a, _) in zip(runs.tolist(), runs.tolist()[1:], strict=False))


@given(st.lists(st.text(alphabet="ab \n\tÄß", max_size=20), max_size=5))
def test_words(texts):
    raw = [t.encode() for t in texts]
    w = common.Words(raw)
    assert [bytes(w.data[a:z]) for a, z in zip(w.starts, w.ends, strict=True)] == [x for t in raw for x in t.split()]
    assert w.n.tolist() == [len(t.split()) for t in raw]
    codes = dict(zip([x for t in raw for x in t.split()], w.code.tolist(), strict=True))
    assert codes == dict(zip([x for t in raw for x in t.split()], common.Words([b" ".join(raw)]).code.tolist(), strict=True))


@given(st.lists(st.integers(0, 3), max_size=50), st.integers(1, 8))
def test_windows(values, length):
    codes = common.BYTE_CODE[np.array(values, np.int64)]
    h = common.Windows(codes).every(length)
    assert len(h) == max(0, len(values) - length + 1)
    seen = {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(tuple(values[i : i + length]), x) == x
    assert len({*seen.values()}) == len(seen)
