"""The shared text functions on slices of Arrow arrays."""

import pyarrow as pa

from vigil.llm._common import slices, split_words, texts


def test_slices_give_whole_texts():
    rows = [None if i % 97 == 0 else f"Word{i} the  Quick\t{i} fÖx " * (i % 7) for i in range(5000)]
    for most in (1, 1000, 100_000, 1 << 30):
        got = []
        for part in slices(pa.array(rows).slice(10), most):
            arr = texts(part)
            codes, offsets, distinct = split_words(arr, lower=True)
            names = distinct.to_pylist()
            got += [(t, [names[c] for c in codes[a:b]]) for t, a, b in zip(arr.to_pylist(), offsets[:-1], offsets[1:], strict=True)]
        low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        assert got == [(t or "", low(t or "").split()) for t in rows[10:]]
