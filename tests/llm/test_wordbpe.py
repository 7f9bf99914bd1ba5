import hashlib
import random

from tokenizers import Tokenizer

from lodestar.llm import wordbpe
from lodestar.llm.common import tokenizer_path
from tests.llm.conftest import ODD

PATH = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ALPHABETS = [
    ["a", "e", "the", "ing", " ", "  ", "'s", "'ll", "'", "...", "12", "ß", "É", "ñ", "\xa0", "\x1c", "\x85", "-", "|", "%%%", "\n", "µ", "ª", "²", "ŉ", "Tion"],
    ["Σ", "ς", "ΟΔΟΣ", "İ", "ǅ", "e\u0301", "\u0301", "ﬁ", "Å", "K", "“", "”", "’s", "—", " ", "the", "'re", "\u2003", "\u200b", "٣", "Ⅷ", "½", "東京", "カ\u3099", "한", "\u1112\u1161", "😀", "👩‍🔬", "ж", "Ж'LL", "<|endoftext|>", "<|startoftext", "|>", "\ufeff", "\U0001e900", "\U00013000", "\u0e01\u0e33", "ⅷ", "\u0345"],
]


def strange(seed):
    rng = random.Random(seed)
    alphabet = ALPHABETS[seed % 2] + (ALPHABETS[0] if seed % 3 == 0 else [])
    return "".join(rng.choice(alphabet) for _ in range(rng.choice([5, 50, 400, 3000])))


def test_ids_and_decoding_equal_the_library(monkeypatch):
    bpe = wordbpe.WordBPE(PATH)
    long_words = ["".join(random.Random(k).choice(a) for _ in range(n)).replace(" ", "") for k, n in ((1, 200), (2, 5000)) for a in ("abcdethe", "жзийяю", "%$#-", "東京都")]
    for leaf, long_word in ((wordbpe.LEAF, wordbpe.LONG_WORD), (7, 3)):
        monkeypatch.setattr(wordbpe, "LEAF", leaf)
        monkeypatch.setattr(wordbpe, "LONG_WORD", long_word)
        bpe.known.clear()
        bpe.older.clear()
        for text in [*ODD, *map(strange, range(240)), *long_words, " ".join(long_words) * 3, "<|startoftext|>hello<|endoftext|>", "<|endoftext|>"]:
            n, joined, back = bpe.describe(text)
            want = library(text)
            assert joined == " ".join(map(str, want)) and n == len(want)
            assert back == LIBRARY.decode(want, skip_special_tokens=False)


def test_classes_are_the_library_s(monkeypatch):
    """Every assigned and unassigned character beside letters, digits and spaces, in the split and in lower case."""
    bpe = wordbpe.WordBPE(PATH)
    every = [chr(c) for c in range(1, 0x110000, 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 4001):
        text = "".join(f"a{c}1{c} " for c in every[at : at + 4001 : 3])
        want = library(text)
        assert bpe.describe(text)[1] == " ".join(map(str, want))


def test_no_text_goes_to_the_library_whole(monkeypatch):
    bpe = wordbpe.WordBPE(PATH)

    class Refusing:
        normalizer = bpe.whole.normalizer

        def __getattr__(self, name):
            raise AssertionError(f"{name} of the whole tokenizer was used")

    bpe.whole = Refusing()
    assert all(bpe.describe(t)[0] >= 0 for t in [*ODD, *map(strange, range(20))])


def test_long_words_by_halves():
    bpe, rng = wordbpe.WordBPE(PATH), random.Random(4)
    for n in (300, 1000, 5000):
        for parts in (["a"], ["ab", "the", "ing", "x"], ["th", "e", "er", "ation", "é"]):
            word = "".join(rng.choice(parts) for _ in range(n))
            assert bpe.long_word(word) == library(word)


def test_query_rows(spark, odd):
    rows = wordbpe.round_trip(odd, PATH).collect()
    assert len(rows) == odd.count()
    want = []
    for r in odd.collect():
        ids = library(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert wordbpe.round_trip(odd.limit(0), PATH).count() == 0
