"""Byte-level BPE of whole texts by prefix-sharing traversal of a trie of words.

The last token of a prefix's encoding is all that is needed to extend it: a token can end a prefix exactly if it is
compatible with the last token of what stands before it, and for every prefix there is one such token. So each trie
node stores one last-token state, which depends on its ancestors only. The distinct words of some texts are
visited in byte order, which is the depth-first order of their trie: the stack of states holds the path, and
a prefix shared with the word before is never computed again.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectile.llm.common import with_text_results

# The pattern that splits text into words before merging, as the vocabulary's publisher states it.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN_WORDS = 300_000
KNOWN_PAIRS = 300_000
NEVER = 1 << 62


def visible_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on in order.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE definition; ids of merged tokens ascend with their rank."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("the definition is not a plain byte-level BPE")
        byte = visible_bytes()
        spelled = lambda token: bytes(byte[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.text = {i: spelled(t) for t, i in vocab.items()}
        self.ids = {t: i for i, t in self.text.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = {(vocab[a], vocab[b]): vocab[a + b] for a, b in pairs}
        self.split = {m: pair for pair, m in self.merged.items()}
        ranks = list(self.merged.values())
        if ranks != sorted(set(ranks)) or len(self.split) != len(pairs) or any(max(p) >= m for p, m in self.merged.items()):
            raise ValueError("token ids do not follow the order of the merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest: dict[int, int] = {}
        for t in self.ids:
            self.longest[t[-1]] = max(self.longest.get(t[-1], 0), len(t))
        self.pairs: dict[tuple[int, int], bool] = {}
        for i, t in [(i, t.encode()) for t, i in self.special.items()]:
            self.text[i] = t

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of ``left`` followed by ``right`` is just these two tokens.

        Goes back in time along the tokens that touch the border: whenever a pair of them could have merged before
        either was used up by a later merge of its own side, the border would be gone. Equal merges go left first.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        x, y, x_ends, y_ends, fits = left, right, NEVER, NEVER, True
        while True:
            across = self.merged.get((x, y))
            if across is not None and across < x_ends and across <= y_ends:
                fits = False
                break
            if x > y and x in self.split:
                x_ends, x = x, self.split[x][1]
            elif y in self.split:
                y_ends, y = y, self.split[y][0]
            elif x in self.split:
                x_ends, x = x, self.split[x][1]
            else:
                break
        self.pairs[left, right] = fits
        return fits

    def encode_sorted(self, words: list[bytes]):
        """The ids of each of ``words``, which are distinct and in byte order, as little-endian 32-bit integers.

        As one token alone fits each prefix, the order of trying is free: first the token before grown by a
        byte, then the byte by itself, then all others from the longest.
        """
        ids, longest, pairs, compatible = self.ids.get, self.longest, self.pairs, self.compatible
        last: list[int] = [-1]  # the last token of every prefix on the path, by its length, and where it starts
        starts: list[int] = [0]
        before = b""
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], starts[shared + 1 :]
            for end in range(len(last), len(word) + 1):
                first = max(0, end - longest[word[end - 1]])
                grown = starts[end - 1]
                start = grown if grown >= first else first
                token = ids(word[start:end])
                if token is None or start and not ((fits := pairs.get(pair := (last[start], token))) or fits is None and compatible(*pair)):
                    start = end - 1
                    token = ids(word[start:end])
                    if start and not ((fits := pairs.get(pair := (last[start], token))) or fits is None and compatible(*pair)):
                        for start in range(first, end - 1):
                            token = ids(word[start:end])
                            if token is not None and (not start or (fits := pairs.get(pair := (last[start], token))) or fits is None and compatible(*pair)):
                                break
                last.append(token)
                starts.append(start)
            found, at = array("i"), len(word)
            while at:
                found.append(last[at])
                at = starts[at]
            found.reverse()
            before = word
            yield found.tobytes()


class WordMemory:
    """The ids of words seen before, at most about ``most`` of them; words that never came again are forgotten first."""

    def __init__(self, most: int):
        self.most, self.known, self.again = most, {}, set()

    def ids_of(self, words: list, encode: Callable[[list], list[bytes]]) -> list[bytes]:
        """The ids of each of ``words``, which are distinct; ``encode`` makes those of new ones."""
        known = self.known
        found = list(map(known.get, words))  # the one look-up of most words
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = [words[i] for i in missing]
        again = [w for w, ids in zip(words, found) if ids is not None]
        self.again.update(again)
        if len(known) + len(new) > self.most:
            keep = self.again if len(self.again) + len(new) <= self.most // 2 else again
            known = self.known = {w: known[w] for w in keep}
            self.again = set()
        coded = encode(new)
        known.update(zip(new, coded))
        for i, ids in zip(missing, coded):
            found[i] = ids
        return found


def gather(found: list[bytes], order: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ids: ``order`` names the words of all lists in turn by their place in ``found``, ``counts`` of them each."""
    ids = np.frombuffer(b"".join(found), "<i4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    length = sizes[order]
    ends = np.concatenate([[0], np.cumsum(length)])
    flat = ids[np.arange(ends[-1]) + np.repeat(starts[order] - ends[:-1], length)]
    return pa.ListArray.from_arrays(pa.array(ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)), pa.array(flat))


class Encoder:
    """Encodes texts call by call and remembers words."""

    def __init__(self, definition: str):
        self.vocabulary = Vocabulary(definition)
        self.words = regex.compile(WORDS)
        self.memory = WordMemory(KNOWN_WORDS)

    def split(self, text: str) -> list[str]:
        special = self.vocabulary.special
        if not special or not self.vocabulary.special_pattern.search(text):
            return self.words.findall(text)
        parts = self.vocabulary.special_pattern.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words.findall(part))]

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        split = [self.split(text) for text in texts]
        coded = pa.array(itertools.chain.from_iterable(split), pa.string(), size=sum(map(len, split))).dictionary_encode()
        found = self.memory.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.encode_words)
        return gather(found, coded.indices.to_numpy(zero_copy_only=False), np.fromiter(map(len, split), np.int64, len(split)))

    def encode_words(self, words: list[str]) -> list[bytes]:
        special = self.vocabulary.special
        spelled = [w.encode() for w in words]
        order = sorted((i for i, w in enumerate(words) if w not in special), key=spelled.__getitem__)
        ids = {i: own for i, own in zip(order, self.vocabulary.encode_sorted([spelled[i] for i in order]))}
        return [ids[i] if i in ids else special[w].to_bytes(4, "little") for i, w in enumerate(words)]


_encoders: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The worker's encoder of a definition, built once and used by all its tasks."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def share_definition(spark: SparkSession, path: str):
    """The definition of a tokenizer, read once by the driver and shared; its size is that of the file."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` as column ``row``, with ``ids``, the token ids of its whole text; null texts count as empty."""
    definition = share_definition(docs.sparkSession, path)

    def ids(texts: pa.Array) -> list[pa.Array]:
        return [_encoder(definition.value).encode(texts.to_pylist())]

    return with_text_results(docs, ids, [("ids", "array<int>")], text)


def decode_lists(vocabulary: Vocabulary, lists: pa.ListArray) -> pa.Array:
    """The texts that lists of ids stand for, special tokens included; malformed UTF-8 becomes U+FFFD, null stays null."""
    spelled = vocabulary.text.__getitem__
    values, at, out = lists.flatten().to_numpy(zero_copy_only=False), 0, []
    for n, there in zip(lists.value_lengths().fill_null(0).to_pylist(), lists.is_valid().to_pylist()):
        out.append(b"".join(map(spelled, values[at : at + n].tolist())).decode("utf-8", "replace") if there else None)
        at += n
    return pa.array(out, pa.string())


def decode_ids(spark: SparkSession, path: str, ids: Column) -> Column:
    """The text of a column of token ids; see ``decode_lists``."""
    definition = share_definition(spark, path)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        return decode_lists(_encoder(definition.value).vocabulary, lists)

    return decode(ids)


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: (doc_id, ids, decoded), where ``decoded`` is made from the ids alone.

    A null text counts as empty; an empty text has no ids and decodes to an empty one. Repeated rows and other
    columns are of no influence, and an empty table gives no rows. Texts of any length are encoded whole. Both directions
    run in one worker, which holds one vocabulary.
    """
    definition = share_definition(docs.sparkSession, path)

    def both(texts: pa.Array) -> list[pa.Array]:
        encoder = _encoder(definition.value)
        ids = encoder.encode(texts.to_pylist())
        return [ids, decode_lists(encoder.vocabulary, ids)]

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_text_results(slim, both, [("ids", "array<int>"), ("decoded", "string")]).select("row.doc_id", "ids", "decoded")
