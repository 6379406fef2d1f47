"""Token ids of documents by a tokenizers file (byte-level BPE).

Texts are cut by ``pretok``; every distinct slice goes through the tokenizers
library's model once per worker (its results are cached), which gives the ids
that encoding the whole text gives. With ``added`` the strings of the file's
added tokens in a text become those tokens, as in the library's own call;
without it they count as ordinary text.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import SliceCache, chunks, encode_texts
from .scratch import lean


def _byte_letters() -> str:
    """The printable stand-in of every byte, at its place: itself where it is
    printable in Latin-1, else the next letter from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    of = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return "".join(of[b] for b in range(256))


@lru_cache(2)
def _model_cache(path: str) -> SliceCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model = whole.model
    letters, id_of = _byte_letters(), attrgetter("id")

    def resolve(pieces):
        joined = codecs.charmap_decode(b"\xff".join(pieces), "strict", letters)[0]     # UTF-8 has no byte FF
        sizes, ids = [], []
        for p in joined.split(letters[0xFF]):
            found = model.tokenize(p)
            sizes.append(len(found))
            ids.extend(map(id_of, found))
        return np.array(sizes, np.int64), ids

    cache = SliceCache(resolve)
    cache.id_bytes = 2 if max(whole.get_vocab(True).values(), default=0) < 1 << 16 else 4      # hold any id
    return cache


@lru_cache(2)
def _added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern that cuts a text at the file's added tokens, and their ids."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if any(t.get(x) for t in tokens for x in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in or look at their neighbours are not supported")
    ids = {t["content"]: t["id"] for t in tokens}
    names = sorted(ids, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None, ids


def _encode_around(texts: list[str], cache: SliceCache, path: str) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts with the added tokens of the file in their places."""
    pattern, token = _added_tokens(path)
    if pattern is None or not any(pattern.search(t) for t in texts):
        return encode_texts(texts, cache)
    cut = [pattern.split(t) for t in texts]                           # every second part is a token
    ids, per_part = encode_texts([x for parts in cut for x in parts[::2]], cache)
    inner = np.concatenate([np.arange(len(parts) // 2 + 1) < len(parts) // 2 for parts in cut])
    ids = np.insert(ids, np.cumsum(per_part)[inner], [token[x] for parts in cut for x in parts[1::2]])
    begin = np.cumsum([0] + [len(parts) // 2 + 1 for parts in cut[:-1]])
    return ids, np.add.reduceat(per_part + inner, begin)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0,
                     key: str = "doc_id", text: str = "text", added: bool = False, packed: bool = False) -> DataFrame:
    """One row per document in the order of the input partitions: key, part
    (number of the task), local (ids of the task's documents before it),
    n_tokens, ids array<int> with ``end_id`` appended. ``added``: added tokens
    are recognised in the texts. ``packed``: ids is binary, little-endian, two
    bytes an id if all ids of the tokenizer fit, else four.

    Null texts count as empty: just the end id. Nothing but key and text is
    read. part and local hold for one evaluation, so write the table before
    using them twice.
    """

    @lean
    def run(batches):
        cache = _model_cache(tokenizer_path)
        width = cache.id_bytes
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            row = 0
            for group in chunks(texts):
                ids, per_text = _encode_around(group, cache, tokenizer_path) if added else encode_texts(group, cache)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(per_text), end_id)
                    per_text = per_text + 1
                upto = np.concatenate([[0], np.cumsum(per_text)])
                if packed:
                    raw = pa.py_buffer(ids.astype(f"<u{width}"))
                    held = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer((upto * width).astype(np.int32)), raw])
                else:
                    held = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(group)),
                    pa.array(np.full(len(group), part, np.int32)),
                    pa.array(local + upto[:-1]),
                    pa.array(per_text),
                    held,
                ], names=["key", "part", "local", "n_tokens", "ids"])
                local += int(upto[-1])
                row += len(group)

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
            .mapInArrow(run, f"key {kind}, part int, local bigint, n_tokens bigint, ids " + ("binary" if packed else "array<int>"))
            .withColumnRenamed("key", key))
