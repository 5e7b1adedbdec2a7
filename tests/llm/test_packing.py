import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quernstone.llm.packing import Coder, PackParams, cut, pack, plan_bins, plan_runs

from .data import documents, no_documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_chunked_ids_equal_the_tokenizer(whole):
    coder, r = Coder(PATH), random.Random(2)
    bits = [" ", "  ", "\n", "\t", " a", "don't", "é", "ñ ", "12", "!?", "<|endoftext|>", " ", "　", "word", "Ünï", "\U0001f600", "'s", " \n", "x.\ny"]
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert np.frombuffer(coder.encode(text) if text else b"", "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_cut_only_shortens_the_first_piece():
    for n in (1, 1023, 1024, 1025, 2048, 3000):
        got = cut(np.arange(n, dtype="<u4").tobytes(), 1024)
        assert sum(p[2] for p in got) == n and all(p[2] == 1024 for p in got[1:]) and [p[1] for p in got] == np.cumsum([0, *(p[2] for p in got)])[:-1].tolist()


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_and_is_near_the_bound(seed):
    r = random.Random(seed)
    counts = Counter(min(1024, max(1, int(r.lognormvariate(5.6, 1)))) for _ in range(4000))
    bins = plan_bins(dict(counts), PackParams(PATH))
    used = Counter()
    for times, lengths in bins:
        assert times > 0 and sum(lengths) <= 1024
        for s in lengths:
            used[s] += times
    assert used == counts
    assert sum(t for t, _ in bins) <= 1.02 * -(-sum(s * n for s, n in counts.items()) // 1024) + 1
    for s, runs in plan_runs(bins).items():
        assert runs[0, 0] == 0 and (runs[:-1, 0] + runs[:-1, 1] == runs[1:, 0]).all() and runs[-1, 0] + runs[-1, 1] == counts[s]


def test_round_trip_and_edges(spark, whole):
    docs = documents(spark).unionByName(spark.createDataFrame([(100 + i, prose(i, 30 * i)) for i in range(1, 40)], "doc_id long, text string"), allowMissingColumns=True)
    got = pack(spark, docs.repartition(5), PackParams(PATH)).collect()
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    sequences, seen = defaultdict(list), Counter()
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            ids = np.array([*whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            seen[r.doc_id] += r.length
    assert seen[1] == 2 * seen[2]  # the repeated row is packed twice
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(spark, no_documents(spark), PackParams(PATH)).count() == 0
