"""Byte-level BPE encoding and decoding over a table of distinct words.

Texts are split into the pieces that BPE never merges across (words with their leading
blank, numbers, symbols, white space). Each distinct word of the corpus is encoded once, where
all chunks that hold it meet (``chunks``), and its ids return to every place of the word.
Decoding goes the other way: ids are joined with the id-to-piece table (the vocabulary
file, of fixed size), and the pieces' bytes are put together.

The tokenizer file is a parameter and is never copied. Results equal those of the
``tokenizers`` library with ``add_special_tokens=False``; a special token's own string in a
text becomes that token, as there.

Defined results: null and empty text have no ids and decode to the empty text; equal texts
get equal ids; a null doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from evisift.llm import chunks
from evisift.llm.chunks import Arrays
from evisift.llm.common import word_hashes

CODES = (
    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
)
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
DIGEST_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
])
CODES_ARROW = pa.schema([*DIGEST_ARROW, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

#: Words handed to the tokenizer at once: what it returns for a word takes about a kilobyte.
ENCODED_WORDS = 10_000


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(4)
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file)["added_tokens"])


def unassigned() -> str:
    """Letters and digits of this machine's ``regex`` that its Unicode tables do not list, as a character class."""
    letters = regex.compile(r"[\p{L}\p{N}]+")
    everything = "".join(map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))))
    odd = [ord(c) for run in letters.findall(everything) for c in run if unicodedata.category(c)[0] not in "LN"]
    if not odd:
        return ""
    points = np.array(odd)
    starts = np.flatnonzero(np.diff(points, prepend=points[0] - 2) > 1)
    ends = np.append(starts[1:], len(points)) - 1
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(starts, ends))


@lru_cache(4)
def splitter(odd: str) -> regex.Pattern:
    """The byte-level split: contractions, letters, digits, symbols (each with a leading blank), white space."""
    letter, digit = (f"[\\p{{{c}}}--[{odd}]]" if odd else f"\\p{{{c}}}" for c in "LN")
    symbol = f"[^\\s\\p{{L}}\\p{{N}}]|[{odd}]" if odd else r"[^\s\p{L}\p{N}]"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?(?:{symbol})+|\s+(?!\S)|\s+")


PLAIN = splitter("")


@lru_cache(4)
def beyond(first: str) -> regex.Pattern:
    """Any character from the first doubtful one on: a cheap test that most texts fail."""
    return regex.compile(f"[{first}-\\U0010ffff]")


def split_text(text: str, specials: tuple[str, ...], odd: str) -> list[str]:
    """The words of one text; the strings of special tokens are words of their own."""
    pattern = splitter(odd) if odd and beyond(odd[:10]).search(text) else PLAIN
    if not any(s in text for s in specials):
        return pattern.findall(text)
    parts = regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text)
    return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else pattern.findall(part))]


@lru_cache(4)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of every id. Byte-level files write each byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    model, specials = tokenizer(path), special_strings(path)
    table = [b""] * model.get_vocab_size()
    for piece, number in model.get_vocab().items():
        table[number] = piece.encode() if piece in specials else bytes(byte_of[c] for c in piece)
    del model
    tokenizer.cache_clear()
    return table


def encode_words(words: np.ndarray | pa.Array, path: str) -> np.ndarray:
    """For each of distinct words, its ids in decimal, joined by commas."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
    out = np.empty(len(words), object)
    for at in range(0, len(words), ENCODED_WORDS):
        portion = tokenizer(path).encode_batch(words[at : at + ENCODED_WORDS].tolist(), add_special_tokens=False)
        out[at : at + ENCODED_WORDS] = [",".join(map(str, e.ids)) for e in portion]
        del portion
    tokenizer.cache_clear()  # of about 100 MB, which would stay with the worker
    return out


def decode_words(ids: np.ndarray, table: list[bytes]) -> np.ndarray:
    """For each list of ids, the bytes of its pieces put together."""
    out = np.empty(len(ids), object)
    out[:] = [b"".join([table[int(i)] for i in x.split(",")]) for x in ids.tolist()]
    return out


def encode(docs: DataFrame, path: str, texts: bool = True) -> DataFrame:
    """Ids and decoded text of every document of ``docs(doc_id, text)``, with digests of both.

    ``texts=False`` leaves the ids and the decoded text out and returns the digests alone.
    """
    specials, odd = special_strings(path), unassigned()
    chars = chunks.corpus_chars(docs)

    def pack(part: pa.Table) -> Arrays:
        counts, codes = [], array("i")
        number: dict[str, int] = {}  # only distinct words are held, not one string for each word of a chunk
        for text in part.column("text").to_pylist():
            words = split_text(text, specials, odd) if text else []
            counts.append(len(words))
            codes.extend([number.setdefault(w, len(number)) for w in words])
        distinct = pa.array(list(number), pa.string())
        order = pc.sort_indices(distinct)  # sorted words and their ids take less room
        place = np.empty(len(order), np.int32)
        place[order.to_numpy(zero_copy_only=False)] = np.arange(len(order), dtype=np.int32)
        return {
            **chunks.ids_of(part), "counts": np.array(counts, np.int64),
            "codes": place[np.array(codes, np.int32)],
            "words": distinct.take(order).to_numpy(zero_copy_only=False),
        }

    def ask(body: Arrays) -> list[tuple[np.ndarray, Arrays]]:
        return [(word_hashes(pa.array(body["words"], pa.string())), {"word": body["words"]})]

    def answer(asked: Iterator[Arrays]) -> Iterator[Arrays]:
        # as Arrow strings: only one message's words at a time are Python strings, of which each takes ten times the room
        lists = [pa.array(x["0.word"], pa.large_string()) for x in asked]
        ends = np.cumsum([len(x) for x in lists])
        coded = pa.concat_arrays(lists).dictionary_encode()
        del lists
        ids, which = encode_words(coded.dictionary, path), coded.indices.to_numpy(zero_copy_only=False)
        return ({"0.ids": ids[x]} for x in np.split(which, ends[:-1]))

    def finish(body: Arrays, reply) -> pa.RecordBatch:
        of_word = reply("0.ids")
        decoded_word = decode_words(of_word, pieces(path))
        n_ids = np.array([x.count(",") + 1 for x in of_word.tolist()], np.int64)
        codes = body["codes"]
        sizes = np.concatenate([[0], np.cumsum(n_ids[codes] if len(n_ids) else [])]).astype(np.int64)
        ends = np.cumsum(body["counts"])
        out = {f.name: [] for f in (CODES_ARROW if texts else DIGEST_ARROW)}
        for doc, a, b in zip(chunks.with_nulls(body).to_pylist(), (ends - body["counts"]).tolist(), ends.tolist()):
            all_ids = ",".join(of_word[codes[a:b]].tolist())
            text = b"".join(decoded_word[codes[a:b]].tolist()).decode("utf-8", "replace")
            out["doc_id"].append(doc)
            out["n_tokens"].append(int(sizes[b] - sizes[a]))
            out["ids_sha256"].append(hashlib.sha256(all_ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            if texts:
                out["ids"].append(all_ids or None)
                out["decoded"].append(text)
        if texts:
            listed = pc.split_pattern(pa.array(out["ids"], pa.string()), ",").cast(pa.list_(pa.int32()))
            out["ids"] = pc.coalesce(listed, pa.scalar([], pa.list_(pa.int32())))
        return pa.RecordBatch.from_pydict(out, schema=CODES_ARROW if texts else DIGEST_ARROW)

    return chunks.ask_all(docs, pack, ask, answer, finish, CODES if texts else DIGEST, chars, one_pass=True)
