"""The memo of the BPE operator, and prefixes that are asked for late."""

import json
import random

import tokenizers

from wavegrid.llm import bpe


def codec():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.Codec(json.load(f))


def test_memo_keeps_what_is_asked_for_again(monkeypatch):
    """Entries in use outlive any number of others, and no more than two generations are held."""
    monkeypatch.setattr(bpe, "MEMO", 10)
    made = []
    memo = bpe.Memo(lambda k: made.append(k) or k)
    for k in range(200):
        assert memo["the"] == "the" and memo[k] == k
        assert len(memo) <= 10 and len(memo.older) <= 10
    assert made.count("the") == 1
    assert memo["x" * bpe.KEPT_LENGTH] and "x" * bpe.KEPT_LENGTH not in memo


def test_small_memo_gives_the_same_ids(monkeypatch):
    """Words of random letters, long ones and marks, against the tokenizers library, while the memos turn over all the time."""
    monkeypatch.setattr(bpe, "MEMO", 3)
    rng = random.Random(4)
    own, other = codec(), tokenizers.Tokenizer.from_file(str(bpe.default_vocabulary()))
    other.no_padding()
    other.no_truncation()
    texts = ["", "a" * 3000, "ab" * 700 + " \n\n x", "it's we'll I'D 12 345\t՘—\U0001f600 é"]
    for _ in range(60):
        letters = rng.choice(["etaoinshr", "abcdefghijklmnopqrstuvwxyz", "éèçàüöäßñó aeinst", "αβγδεабвгд漢字 "])
        texts.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(20)))
    for text in texts:
        ids = other.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert own.decode(own.encode(text)) == other.decode(ids, skip_special_tokens=False)
