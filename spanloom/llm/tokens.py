"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's path is a parameter.

A text is encoded once and whole. Its tokens' bytes give each token's place, so the tokens of prompt lines need no second
encoding: a token belongs to the line in which it starts.

Defined results: null and empty texts have 0 tokens. Texts of any length, and blanks of any number in a row, are encoded
whole: a run of blanks that the tokenizer's pattern can't take at once is cut where the pattern itself ends a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary divides a text into words before it is encoded (fixed value of the vocabulary).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lines of a speaker whose tokens bear no loss, as in instruction data.
PROMPT_LINE = r"^(?:user|human|system):.*$"
_BLANKS = re.compile(r"\s{2000,}")
SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


def _starts(vocabulary: bytes | None, path: str, pattern: str) -> Callable[[str], tuple[int, Callable[[], np.ndarray]]]:
    """A function from a text to its number of tokens and, when asked, the byte at which each of them starts."""
    if vocabulary is None:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True

        def encode(text: str):
            e = tok.encode(text, add_special_tokens=False)
            width = np.array([0, *np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])])
            return len(e.ids), lambda: width[[a for a, _ in e.offsets]]

        return encode
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids_of(text: str) -> list[int]:
        out, at = [], 0
        for m in _BLANKS.finditer(text):
            # all blanks of a run are one word but for the last, which belongs to what follows
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += enc.encode_ordinary(text[at : m.start()]) + enc._encode_single_piece(text[m.start() : end])
            at = end
        return out + enc.encode_ordinary(text[at:])

    def encode(text: str):
        ids = ids_of(text)
        return len(ids), lambda: np.cumsum(size[ids]) - size[ids]

    return encode


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), tokenizer: str = DEFAULT_TOKENIZER, prompt_line: str = PROMPT_LINE, pattern: str = WORD_PATTERN, with_prompts: bool = False) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``n_tokens`` and ``n_loss``, the tokens outside lines that are prompts.

    ``with_prompts`` adds ``prompts``, the ranges of tokens of these lines. A vocabulary in ranks (``.tiktoken``) is read
    here, once, and travels with the tasks; other files are read by the tasks.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c) for c in keep])
    schema = slim.drop("text").schema.add("n_tokens", T.IntegerType()).add("n_loss", T.IntegerType())
    if with_prompts:
        schema = schema.add("prompts", SPANS)
    prompt, vocabulary = re.compile(prompt_line, re.M), None
    if tokenizer.endswith(".tiktoken"):
        with open(tokenizer, "rb") as f:
            vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # one file, below 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _starts(vocabulary.value if vocabulary else None, tokenizer, pattern)
        for rb in batches:
            n, loss, ranges = [], [], []
            for t in rb.column("text").to_pylist():
                k, starts = encode(t) if t else (0, None)
                lines, at = [], None
                for m in prompt.finditer(t) if t else ():
                    at = starts() if at is None else at
                    begin = len(t[: m.start()].encode("utf-8", "surrogatepass")) if not t.isascii() else m.start()
                    end = begin + (len(m[0].encode("utf-8", "surrogatepass")) if not t.isascii() else len(m[0]))
                    a, b = np.searchsorted(at, (begin, end))
                    if b > a:
                        lines.append({"from": int(a), "to": int(b)})
                n.append(k)
                loss.append(k - sum(x["to"] - x["from"] for x in lines))
                ranges.append(lines)
            cols = [rb.column(c) for c in rb.schema.names if c != "text"] + [pa.array(n, pa.int32()), pa.array(loss, pa.int32())]
            names = [*[c for c in rb.schema.names if c != "text"], "n_tokens", "n_loss"]
            if with_prompts:
                cols.append(pa.array(ranges, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))))
                names.append("prompts")
            yield pa.record_batch(cols, names=names)

    return slim.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
