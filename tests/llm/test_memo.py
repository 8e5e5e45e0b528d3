"""The encoder's memory stays bounded, and common pieces outlast a flood of rare ones."""

from bookloom.llm.tokenizer import Encoder, default_path


def test_common_pieces_outlast_rare_ones():
    e, memo = Encoder(default_path("byte_bpe_50k.json"), memo=200), 200
    learned, learn = [], e._learn
    e._learn = lambda known, keys, before: learned.extend(keys) or learn(known, keys, before)
    for i in range(60):
        text = "the common words " + " ".join(f"rare{i}x{j}" for j in range(20))
        assert e.ids([text])[0] == b"".join(x.to_bytes(4, "little") for x in e.whole(text))
    assert learned.count("common") == 1 and learned.count("rare3x4") == 1
    held = [*e.pieces, *e.older]
    assert sum(map(len, held)) <= 2 * memo and len(e.words) + len(e.older_words) <= 2 * memo


def test_new_pieces_of_many_texts_are_encoded_together():
    """op3_packing, op9_planes: a call of the library for each text cost more than its tokens."""
    texts = [f"word{i} an'd \"q{i}.\nNext{i}\" été{i},\nÇa <|endoftext|>{i} x{i}\n\ny" for i in range(50)]
    texts += [f" odd{i}  \t spaces {i} \n" for i in range(10)] + ["", " ", "\x1c a\x1c", "\nA", "İ İ{i}\nİ"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(default_path(name))
        assert e.runs
        calls, learn = [], e._learn
        e._learn = lambda known, keys, before: calls.append(before) or learn(known, keys, before)
        got = e.ids(texts)
        assert got == [b"".join(x.to_bytes(4, "little") for x in e.whole(t)) for t in texts]
        assert len(calls) == 2
