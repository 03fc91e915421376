"""BPE encoding and decoding by dynamic programming over prefixes.

The byte-pair encoding of a pre-token has one last token for each of its prefixes. For prefix
i, each vocabulary entry that is a suffix of the prefix (found by an automaton over all
entries) is tried: entry t of length l is the last token if the last token of prefix i - l can
stand before t, that is if merging the two tokens' bytes gives the two tokens again. Following
back from the end gives the ids. A prefix's last token is found when a longer prefix asks for it,
the longest entries first.

Two tokens can stand together unless a merge across their seam comes first: the right edge of
the left token and the left edge of the right token pass through stages (the tokens of their
merge trees along the seam), and a pair of stages that exist at the same time must have no
merge that is due before both are merged into their own tree.

Edge cases: a null text counts as empty and has no ids; a very long text is encoded whole, each
pre-token in time in proportion to its length; repeated rows are encoded one by one; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import columns_of, documents, free_name, in_small_batches, once

#: How byte-level tokenizers split a text before merging (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that newer Unicode tables call letters or digits and the tokenizer's tables
#: (Unicode 16) do not (fixed values: first and last of each range, hexadecimal).
NOT_YET = """
558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4
A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686
16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2
18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
NEVER = 1 << 60
#: Entries of a generation of a worker's memo of pre-tokens or token pairs, and the longest pre-token that is kept.
MEMO, KEPT_LENGTH = 100_000, 200
#: Texts whose UTF-8 bytes are all smaller have no code point of NOT_YET: the first one starts with this byte.
LATER_BYTE = chr(int(NOT_YET[0].split("-")[0], 16)).encode()[0]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies -> the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Memo(dict):
    """Results of a function. When MEMO of them are held they become the older ones, of which those asked for again live on."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if isinstance(key, str) and len(key) >= KEPT_LENGTH:
            return value
        if len(self) >= MEMO:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encodes and decodes with a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, described: dict):
        letters = byte_letters()
        vocab = described["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.sizes = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, m in enumerate(described["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merge[pair] = r
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, r
        self.automaton = ahocorasick.Automaton()
        entries = {raw: i for i in vocab.values() if len(raw := self.bytes_of[i]) == 1 or i in self.parts}
        for raw, i in entries.items():
            self.automaton.add_word(raw.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = {i: len(raw) for raw, i in entries.items()}
        #: The longest entry that an entry ends with.
        self.shorter = {i: next((entries[raw[k:]] for k in range(1, len(raw)) if raw[k:] in entries), None) for raw, i in entries.items()}
        self.split = regex.compile(SPLIT)
        later = "[" + "".join(f"\\U{a:0>8}-\\U{b:0>8}" for a, b in (x.split("-") for x in NOT_YET)) + "]"
        self.later = regex.compile(later)
        narrow = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{later}]").replace(r" ?\p{L}", rf" ?[\p{{L}}--{later}]").replace(r" ?\p{N}", rf" ?[\p{{N}}--{later}]")
        self.split_later = regex.compile(narrow, regex.V1)
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.fits = Memo(lambda pair: self.can_stand(pair >> 32, pair & 0xFFFFFFFF))
        self.known = Memo(self.word)
        self.edges: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Along one edge (0 left, 1 right) of a token's merge tree: (token, rank that makes it, rank that takes it in)."""
        if (token, side) not in self.edges:
            out, taken, t = [], NEVER, token
            while True:
                made = self.rank.get(t, -1)
                out.append((t, made, taken))
                if t not in self.parts:
                    break
                t, taken = self.parts[t][side], made
            self.edges[token, side] = out
        return self.edges[token, side]

    def can_stand(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens merge to just these two tokens."""
        for a, a_made, a_taken in self.edge(left, 1):
            for b, b_made, b_taken in self.edge(right, 0):
                due = self.merge.get((a, b))
                # Equal merges go from left to right: at equal rank the left token's own comes
                # before the seam's, and the seam's before the right token's own.
                if due is not None and due < a_taken and due <= b_taken and a_made < b_taken and b_made < a_taken:
                    return False
        return True

    def word(self, word: str) -> bytes:
        """The ids of a pre-token, as little-endian unsigned 32-bit integers."""
        raw = word.encode().decode("latin-1")
        # The automaton tells the longest entry at an end first: so it is the one that stays.
        longest = dict(reversed(list(self.automaton.iter(raw))))
        last, fits, length, shorter = [-1] * (len(raw) + 1), self.fits, self.length, self.shorter
        asked, tried = [len(raw)], [longest[len(raw) - 1]] if raw else []
        while tried:
            end, token = asked[-1], tried[-1]
            start = end - length[token]
            if start:
                before = last[start]
                if before < 0:
                    asked.append(start)
                    tried.append(longest[start - 1])
                    continue
                if not fits[before << 32 | token]:
                    tried[-1] = shorter[token]
                    continue
            last[end] = token
            asked.pop()
            tried.pop()
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def has_later(self, piece: str) -> bool:
        """Whether there is a code point of NOT_YET in it."""
        if piece.isascii() or np.frombuffer(piece.encode(), np.uint8).max() < LATER_BYTE:
            return False
        return self.later.search(piece) is not None

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if self.specials is not None and any(t in text for t in self.special):
            pieces = self.specials.split(text)
        else:
            pieces = [text]
        out, known = [], self.known
        for piece in pieces:
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
                continue
            split = self.split_later if self.has_later(piece) else self.split
            out.extend(map(known.__getitem__, split.findall(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[tokens] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.joined[at].tobytes().decode("utf-8", "replace")


def bpe_tokens(docs: DataFrame, vocabulary: str, column: str = "bpe", keep_ids: bool = True) -> DataFrame:
    """docs with a struct of n_tokens, ids (bytes; null unless keep_ids), ids_sha256 and decoded_sha256.

    vocabulary is a file that the driver reads; its content (a few MB, whatever the corpus) is
    broadcast. Each worker process builds the automaton once.
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()
    key, sent = hashlib.sha256(raw).hexdigest(), docs.sparkSession.sparkContext.broadcast(gzip.compress(raw))
    name = free_name(docs, column)

    def encode(text: pa.Array) -> pa.Array:
        codec = once(("bpe", key), lambda: Codec(json.loads(gzip.decompress(sent.value))))
        n, kept, hashed, decoded = [], [], [], []
        for value in text:
            t = value.as_py() or ""
            ids = codec.encode(t)
            n.append(len(ids) // 4)
            kept.append(ids if keep_ids else None)
            hashed.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())],
            names=["n_tokens", "ids", "ids_sha256", "decoded_sha256"],
        )

    encoded = F.arrow_udf(encode, "struct<n_tokens bigint, ids binary, ids_sha256 string, decoded_sha256 string>").asNondeterministic()
    return in_small_batches(docs).withColumn(name, encoded(*columns_of(docs, "text")))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    out = bpe_tokens(documents(spark, sf_dir).select("doc_id", "text"), default_vocabulary(), keep_ids=False)
    return out.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")
