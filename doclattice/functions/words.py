"""Words of whole Arrow batches: the same as ``text.lexemes`` gives, without an array of strings in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def words_of(lowered: pa.Array, drop: Iterable[str] = ()) -> pa.ListArray:
    """Runs of letters and numbers of lower-cased texts, without the words to ``drop``; none for NULL."""
    if isinstance(lowered, pa.ChunkedArray):
        lowered = lowered.combine_chunks()
    plain = pc.replace_substring_regex(pc.fill_null(lowered, ""), pattern=r"[^\pL\pN]+", replacement=" ")
    return _without(split_words(pc.ascii_trim(plain, " ")), ["", *drop])


def split_words(joined: pa.Array) -> pa.ListArray:
    return pc.split_pattern(joined, " ")


def _without(lists: pa.ListArray, drop: list[str]) -> pa.ListArray:
    flat = pc.list_flatten(lists)
    keep = pc.invert(pc.is_in(flat, value_set=pa.array(drop, flat.type)))
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(kept[ends], pa.int32()), flat.filter(keep))
