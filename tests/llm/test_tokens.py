import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagewright.llm import storage, token_counts, token_files

ODD = ["", " ", "a", "  a  b", "a\tb\nc", "<s> x </s>", "日本é", "a b　c", "a\x00b", "▁a", "A▁ b", "\n", " \n x", "x \n\n y", "\nx", "🙂🙂 ▁▁", "Über\r\nÉa", "a" * 5000, "ab " * 3000, "<|endoftext|>x <|startoftext|> I'll don't",
       "é ́x", "x\x1cy\x85z", "ΑΣ Σ", "İI", "<|ENDOFTEXT|> A", "İ Å"]


def texts(n=400):
    draw, parts = random.Random(5), ["the", "tion", " ", "  ", "\n", ".", "é", "▁", "日", "ing", "\t", "ß", "0", "'s", "<s>", "́"]
    return ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_counts_match_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.merger(path)
    for t in texts():
        assert own.count(t) == len(model.encode(t)), repr(t)


def test_count_column(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b")], "id int, text string")
    got = sorted((r.id, r.n) for r in rows.select("id", token_counts.token_count(F.col("text"), path).alias("n")).collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2)]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_are_directly_addressable(n):
    ids = np.random.default_rng(n).choice([0, 1, 255, 256, 49407, 65535, 65536, 1 << 31], n).astype("<u4")
    data = b"".join(token_files.pack([7], np.array([0, n]), ids))
    got = token_files.TokenFile(data)
    assert (got.all() == ids).all() and [got[i] for i in range(n)] == ids.tolist()
    if n:
        with pytest.raises(ValueError):
            token_files.TokenFile(data[:-1] + bytes([data[-1] ^ 1]))


@pytest.mark.parametrize("kept", [5, 300_000])
def test_ids_match_the_library(kept, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(path)
    monkeypatch.setattr(token_files, "KEPT_WORDS", kept)
    for t, got in zip(texts(), [x for i in range(0, len(texts()), 7) for x in own.texts(texts()[i : i + 7])], strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def round_trip(spark, rows, roll=50):
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string")
    folder = storage.new_file_folder(spark, "tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write(docs, path, 1, folder, 3, roll)
    return token_files.read(manifest, folder).collect()


def test_files_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t, "x") for i, t in enumerate(texts(60))] + [(None, "null id", None), (3, None, None), (5, ODD[5], "x")]
    got = sorted(round_trip(spark, rows), key=lambda r: r.start)
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at, by = 0, {}
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        by.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by[r.doc_id]
        at += r.n_tokens


def test_empty_table(spark):
    assert round_trip(spark, []) == []


def test_plain_words_go_to_the_model_alone():
    """What precedes the library's model took most of the time of new words."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, draw, asked = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(8), []
    plain = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(1, 90))) for _ in range(300)]
    odd = ["don't", "x1", "é", "ﬁ", "1,", "a,.", "<|x", "q.r"]
    before = own.encoded
    own.encoded = lambda words: asked.extend(words) or before(words)
    for given in (plain + odd, [w.upper() for w in plain], [w + "." for w in plain], [w + "," for w in plain[:9] + odd]):
        text = " ".join(given)
        assert np.frombuffer(own.texts([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert not any(w.isalpha() and w.islower() for w in asked) and asked
    assert all(len(w) <= token_files.KEPT_LENGTH for w in own)


def test_words_are_looked_up_once_for_many_texts():
    """A look-up for each occurrence took most of the time."""
    own, asked = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json")), []

    class Seen(token_files.Encoder):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    own.__class__ = Seen
    alone = [own.texts([t])[0] for t in ("The cat.", "", "the\nDOG the <|endoftext|>", " the  dog ")]
    asked.clear()
    assert own.texts(["The cat.", "", "the\nDOG the <|endoftext|>", " the  dog "]) == alone
    del asked[:]
    got = own.texts(["the dog " * 500, "", "THE Dog"])
    assert got == [alone[3] * 500, b"", alone[3]] and len(asked) == 2
    assert own.texts([]) == [] and own.texts(["", " "]) == [b"", b""]


def test_marks_and_latin_letters_go_to_the_model_alone():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, draw, asked = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(9), []
    letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7] + list("abcdefghijklmnopqrstuvwxyz") * 2
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    plain = ["".join(draw.choices(letters, k=draw.randint(1, 70))) for _ in range(600)]
    given = [w + "".join(draw.choices(marks, k=draw.randint(0, 5))) for w in plain] + [w + m for w in ("à", "s", "don") for m in (*marks, "'" * 3, "<|", "|>")]
    before = own.encoded
    own.encoded = lambda words: asked.extend(words) or before(words)
    text = " ".join(w for w in given if "<|" not in w)
    assert np.frombuffer(own.texts([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked and not any(c.isalnum() for w in asked for c in w.decode())
    odd = ["é÷é.", "À.", "e\u0301...", "à\u0301!", "ÀB!!", "a÷", "don't...", "x'll!!", "x's''", "1&&", "a1&&", "é1.", "<|endoftext|>...", "a<|endoftext|>!", "<|", "a<|", "a.b!!", "ǆ!", "ªº!"]
    for t in [*given, *odd, " ".join(odd)]:
        assert np.frombuffer(own.texts([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
