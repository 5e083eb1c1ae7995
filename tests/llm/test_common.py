import numpy as np
import pyarrow as pa

from tessitura.llm import common


def test_word_hashes(monkeypatch):
    texts = [b"", b"  a bb\tccc\n a", b"a", b"\n", "é bb Ccc".encode(), b"x" * 500 + b" a " + b"y " * 300, b"bb ccc"]
    whole = common.word_hashes(texts)
    assert [len(h) for h in whole] == [0, 4, 1, 0, 3, 302, 2]
    assert whole[1][0] == whole[1][3] == whole[2][0] == whole[5][1] and whole[1][1] == whole[4][1] == whole[6][0]
    assert len({int(x) for h in whole for x in h}) == len({w for t in texts for w in t.split()})
    monkeypatch.setattr(common, "HASHED_BYTES", 64)
    for a, b in zip(whole, common.word_hashes(texts), strict=True):
        assert np.array_equal(a, b)
    assert common.word_hashes([b"AbC", b"abc"], lower=True)[0] == common.word_hashes([b"abc"])[0]
    assert common.word_hashes([]) == []


def test_rows_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a", None]})
    assert list(common.rows([batch])) == [([1, 2], [b"a", b""])] and len(calls) == 2
    assert list(common.rows([])) == [] and len(calls) == 4
