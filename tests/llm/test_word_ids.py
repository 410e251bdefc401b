"""The tokenizer's known words."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import tokenizers

from timegrid.llm.packing import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_frequent_words_stay_known_when_others_go():
    words, asked = WordIds(PATH, most=40), []
    learn = words._learn
    words._learn = lambda new: (asked.extend(new), learn(new))[1]
    whole = tokenizers.Tokenizer.from_file(PATH)
    for i in range(30):
        texts = [" ".join(["often", "öfter,", *(f"wört{chr(97 + i)}{chr(97 + k)}" for k in range(20))]), "often \x01 1x"]
        ids, counts = words.ids(pa.array(texts))
        want = [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
        assert words.size <= 40 + 25 + 1
    assert asked.count(b"often") == asked.count("öfter,".encode()) == asked.count(b"\x01") == 1
    assert len(asked) == 4 + 30 * 20
