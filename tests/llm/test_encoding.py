import random

import pytest

from spendlens.llm.encoding import Encoder, in_portions, public_path

PATH = public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoders():
    return Encoder(PATH), Encoder(PATH, counting=True), Encoder(PATH, counting=True, known={"the": 1, "B": 1})


def check(encoders, texts):
    ids, counts, known = encoders
    whole = [ids._whole(t) for t in texts]
    assert ids.encode(texts) == whole
    assert counts.encode(texts) == [len(w) // 4 for w in whole]
    assert known.encode(texts) == [len(w) // 4 for w in whole]


@pytest.mark.parametrize("alphabet", [" \n\t\r\x0b\x0c\x1c\x85\xa0　aBéñ中1².,!?'s-_́😀ر\0", " \naB.,'s1  \n", "ab c\n"])
def test_pieces_give_the_ids_of_the_whole_text(encoders, alphabet):
    rnd = random.Random(alphabet)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    check(encoders, texts)


def test_special_strings_long_words_and_nothing(encoders):
    check(encoders, ["", " ", "\n", "a<|endoftext|>b", " <|endoftext|> ", "don't we'll 's", "x" * 5000 + " the y", "the B the"])
    check(encoders, [])


def test_a_full_cache_changes_nothing():
    small = Encoder(PATH, limit=3)
    texts = [f"some words and number {n}\nthen more" for n in range(20)]
    for text in texts:
        assert small.encode([text]) == [small._whole(text)]


def test_portions_hold_all_texts_in_order():
    texts = ["a" * n for n in (0, 5, 20, 1, 1, 30)]
    assert [t for p in in_portions(texts, 10) for t in p] == texts
    assert list(in_portions([])) == []
