import pyarrow as pa

from quernstone.functions.batches import by_portions, portions


def test_a_batch_is_taken_in_portions_and_keeps_its_order():
    seen = []

    def upper(texts):
        seen.append(len(texts))
        return [t and t.upper() for t in texts]

    batches = [pa.array([None if i % 7 == 0 else f"é{i}" for i in range(1000)]), pa.array([], pa.string()), pa.array(["a"])]
    out = list(by_portions(upper, pa.string())(iter(batches)))
    assert [o.to_pylist() for o in out] == [[t and t.upper() for t in b.to_pylist()] for b in batches]
    assert max(seen) == 256 and sum(seen) == 1001
    assert [len(p) for p in portions(batches[0])] == [256, 256, 256, 232]
