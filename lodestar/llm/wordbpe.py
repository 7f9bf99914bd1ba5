"""Word-level BPE encoding and decoding by tree concatenation.

A long text is cut into halves, and halves into leaves, each encoded on its own, in parallel. Around each join a
window of the neighbours' outermost pieces is encoded again and grows until both of its ends agree with what stands
left and right of it. That holds for both levels: texts are joined over the words of the split pattern, and a long word
without a split is joined over BPE tokens. Two sequences of tokens whose every neighbouring pair is what BPE makes of
that pair are BPE's own answer, so a window that agrees at both ends is exact.

Words repeat, so their ids are kept in a bounded table. Every text takes the tree: characters beyond Latin script are
normalised by the library's normaliser and split by its own classes, and strings of added tokens, which the library cuts
out before anything else, stand between the texts that do.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import printable_bytes

LATIN = 0x180  # below, NFC changes nothing, and lower case is one character for each but U+0130


def _class(kind: str) -> str:
    """The characters below LATIN of a general category, for a pattern's brackets."""
    return "".join(map(re.escape, (c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == kind)))


def _pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    """Fixed value: the split pattern of this vocabulary's pre-tokenizer, with its classes spelled out."""
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


SPLIT = _pattern(_class("L"), _class("N"), r"\t-\r \x85\xa0")
LEAF = 1 << 9  # characters of a leaf of the text tree
LONG_WORD = 64  # characters from which a word is encoded by halves


def _ranges(found: list[str]) -> str:
    """Ascending characters as ranges, for a pattern's brackets."""
    out, at = [], 0
    while at < len(found):
        to = at
        while to + 1 < len(found) and ord(found[to + 1]) == ord(found[to]) + 1:
            to += 1
        out.append(re.escape(found[at]) + (f"-{re.escape(found[to])}" if to > at else ""))
        at = to + 1
    return "".join(out)


@lru_cache(maxsize=1)
def split_all() -> re.Pattern:
    """The split pattern for texts of any characters: classes as the tokenizers library itself has them."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    classes = []
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        cut = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
        classes.append(_ranges(sorted(c for at in range(0, len(every), 1 << 16) for piece, _ in cut.pre_tokenize_str(every[at : at + (1 << 16)]) for c in piece)))
    return _pattern(*classes)
WORDS_KEPT = 250_000  # of each of two generations


class WordBPE:
    """ids and pieces as tokenizers' encode(text, add_special_tokens=False) gives them, and decode() of those ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        to_char = {b: c for c, b in printable_bytes().items()}
        self.whole = Tokenizer.from_str(json.dumps(data | {"truncation": None, "padding": None}))
        bare = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "added_tokens": []}
        ended = data | bare | {"truncation": None, "padding": None}
        self.end = Tokenizer.from_str(json.dumps(ended))  # one word, to its end
        self.inner = Tokenizer.from_str(json.dumps(ended | {"model": data["model"] | {"end_of_word_suffix": None}}))  # a part before the end
        self.special = [t["content"] for t in data["added_tokens"]]
        self.model = self.end.model
        self.to_char = to_char
        self.shown = {c: "".join(to_char[b] for b in chr(c).encode()) for c in range(LATIN)}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_ids = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def plain(self, text: str) -> bool:
        """Whether str.lower() is the library's normalisation, but for white space: Latin letters, no added token, no dotted capital I."""
        return text.isascii() and "<|" not in text or (max(text) < chr(LATIN) and "İ" not in text and not any(s in text for s in self.special))

    def word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, tokens joined by spaces) of a word."""
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            if len(word) > LONG_WORD:
                ids = self.long_word(word)
                tokens = [self.end.id_to_token(i) for i in ids]
            else:
                pieces = self.model.tokenize(self.as_bytes(word))
                ids, tokens = [p.id for p in pieces], [p.value for p in pieces]
            found = (len(ids), " ".join(map(str, ids)), " ".join(tokens))
        if len(self.known) >= WORDS_KEPT:
            self.known, self.older = {}, self.known
        self.known[word] = found
        return found

    def as_bytes(self, word: str) -> str:
        """The characters that stand for the word's bytes."""
        if word.isascii() and word.isprintable():
            return word
        return word.translate(self.shown) if max(word) < chr(LATIN) else "".join(self.to_char[b] for b in word.encode())

    def long_word(self, word: str) -> list[int]:
        """The ids of one long word: halves, encoded apart in one parallel call, then joined pairwise."""
        cuts = [0, len(word)]
        while any(b - a > LONG_WORD for a, b in zip(cuts, cuts[1:], strict=False)):
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False) if b - a > LONG_WORD)})
        parts = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        runs = [e.ids for e in self.inner.encode_batch(parts[:-1], add_special_tokens=False)] + [self.end.encode(parts[-1], add_special_tokens=False).ids]
        while len(runs) > 1:
            last = len(runs) - 2
            runs = [self.join(runs[k], runs[k + 1], k >= last) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0]

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """Encode a growing window of both sides' tokens until its first and last token are those that stand there."""
        size = 2
        while True:
            a, b = min(size, len(left)), min(size, len(right))
            window = left[len(left) - a :] + right[:b]
            at_end = ends and b == len(right)
            now = self.tokens_of(window, at_end)
            left_ok = a == len(left) or now[0] == window[0]
            right_ok = b == len(right) or now[-1] == window[-1]
            if left_ok and right_ok:
                return left[: len(left) - a] + now + right[b:]
            size *= 2

    def tokens_of(self, ids: list[int], at_end: bool) -> list[int]:
        """The ids of the bytes that `ids` stand for, encoded as one run."""
        text = "".join(map(self.end.id_to_token, ids))
        if at_end:
            text = text.removesuffix("</w>")
        model = self.end if at_end else self.inner
        pieces = model.model.tokenize(text)
        return [p.id for p in pieces]

    def words(self, text: str, split: re.Pattern = SPLIT) -> list[str]:
        """The words of a normalised text, by the tree."""
        if len(text) <= LEAF:
            return split.findall(text)
        cuts = list(range(0, len(text), LEAF)) + [len(text)]
        runs = [[(m.start(), m.end()) for m in split.finditer(text, a, b)] for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(runs) > 1:
            runs = [join_spans(text, runs[k], runs[k + 1], split) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return [text[a:b] for a, b in runs[0]]

    def found(self, text: str) -> list[tuple[int, str, str]]:
        """word() of every word and added token of a text."""
        if self.plain(text):
            return [self.known.get(w) or self.word(w) for w in self.words(text.lower())]
        out, normalise = [], self.whole.normalizer.normalize_str
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special_ids:
                out.append((1, str(self.special_ids[part]), part))
            elif part:
                out += [self.known.get(w) or self.word(w) for w in self.words(normalise(part), split_all())]
        return out

    def describe(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded text)."""
        found = self.found(text) if text else []
        if not found:
            return 0, "", ""
        n, ids, pieces = zip(*found, strict=True)
        return sum(n), " ".join(ids), " ".join(pieces)

    def ids(self, text: str | None) -> list[int]:
        return [int(x) for x in self.describe(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)


def join_spans(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], split: re.Pattern = SPLIT) -> list[tuple[int, int]]:
    """Split a growing window around the join again until it ends in the word that ends there on the right.

    What stands before a word's start does not change the words from there on, so the window starts at the last but one
    on the left: the last may run on, and an apostrophe before it may take it in. A side without words is white space, which no word runs into.
    """
    if not left or not right:
        return left or right
    size = 1
    while True:
        size = min(2 * size, len(right))
        window = [(m.start(), m.end()) for m in split.finditer(text, left[-2:][0][0], right[size - 1][1])]
        if size == len(right) or window[-1] == right[size - 1]:
            return left[:-2] + window + right[size:]


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and the sha256 of the decimal ids joined by spaces and of the decoded text, per row of `docs`.

    Null and empty texts have no ids and decode to the empty text. Repeated rows and ids give a row each; an empty table gives
    none. Other columns of `docs` are not read.
    """

    def described(batches):
        bpe = word_bpe(tokenizer)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch["text"].to_pylist():
                count, joined, back = bpe.describe(text)
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(described, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
