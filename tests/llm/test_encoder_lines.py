import public_tokenizers
from tokenizers import Tokenizer

from stationlake.llm.tokenfiles import Encoder

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_words_across_a_line_end_need_no_splitting():
    encode, library = Encoder(FILE), Tokenizer.from_file(FILE)
    for word in [" inwh.\nWas", "a\nb,\nc", " Straße!!!!\nÜber.", "x"]:
        assert encode._directly(word) == library.encode(word, add_special_tokens=False).ids
    for word in [" a\n\nb", "a\n b", " a1\nb", "\na", "a\n", ""]:
        assert encode._directly(word) is None
    texts = ["a\nb a\nb c\n\nd", "", " a.\nB é!!!\nx", "a\n b"]
    ids, n = encode(texts, 0)
    whole = [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == sum(whole, []) and n.tolist() == [len(w) for w in whole]
    assert all(len(m) <= 2 for m in encode.marks)
