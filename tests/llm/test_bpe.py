import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexispark.llm.bpe import BPE, default_path, encode_decode

ALPHABET = "aAbB tTheEéÉßΣσς'’\t\n\x0b\x1c\x85\xa0  01٣½漢字🙂🏽éİ.,;-_%$ﬁ​　"
SCHEMA = "n_tokens long, doc_id long, text string, ids string"


def texts():
    rnd = random.Random(5)
    out = [None, "", " ", "I'LL don't <|endoftext|> x<|startoftext|><|ENDOFTEXT|>", "a" * 5000, "the quick " * 20000, "!=-" * 50]
    out += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    out += ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 50))) for _ in range(300)]
    return out


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_same_as_the_library(library):
    mine = BPE(default_path())
    for t in texts():
        want = library.encode(t or "", add_special_tokens=False).ids
        got = np.frombuffer(mine.encode(t or ""), "<u4")
        assert got.tolist() == want
        assert mine.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library):
    mine = BPE(default_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 512):
        # each one stands alone and between letters
        text = " ".join(f"{c} a{c}b" for c in points[k : k + 512])
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(points[k]))


def test_query_shape(spark, library):
    rows = [(9, i, t, "x") for i, t in enumerate(texts())] + [(9, 3, texts()[3], "x")]
    got = encode_decode(spark.createDataFrame(rows, SCHEMA), with_text=True).collect()
    assert len(got) == len(rows)
    all_ = texts()
    for r in got:
        want = library.encode(all_[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(want) and list(r.ids) == want
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert encode_decode(spark.createDataFrame([], SCHEMA)).collect() == []
