"""Blocks of the n-gram model are packed and asked for piece by piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tracecairn.llm import knlm
from tracecairn.llm.common import chunks


def test_a_block_is_unpacked_batch_by_batch():
    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + k) for k in rng.integers(0, 20, 20_000)) for _ in range(150)] + [None, ""]
    block = pa.RecordBatch.from_pydict({
        "doc_id": list(range(len(texts))), "_text": pa.array(texts, pa.string()),
        "_lang": ["en", None] * (len(texts) // 2)})
    packed = list(knlm._pack(iter([block])))
    asked = list(knlm._ask(iter([block]), knlm.CHARACTERS))
    assert len(packed) == len(asked) == 1
    with pa.ipc.open_stream(packed[0].column(1)[0].as_buffer()) as stream:
        parts = list(stream)
    assert len(parts) == 3 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([block]))
    names = asked[0].column(0).unique().to_pylist()
    assert names == packed[0].column(0).to_pylist()
    keys, at, _, _ = knlm.gram_keys([x or "" for x in texts], block.column(2).to_pylist())
    order, want = knlm.CHARACTERS.order, {0}
    for k in range(order + 1):
        want |= set(keys[k][at].view(np.int64).tolist())
        want |= set(keys[k][at - 1].view(np.int64).tolist()) if k < order else set()   # contexts
    got = asked[0].column(1).to_pylist()
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(list(chunks(iter([block]), "_text", knlm.PIECE_BYTES))) > knlm.MERGED_PIECES // 2
