"""Prefix tables against the reference encoder of the same vocabulary, and under appends and edits."""

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import encode

PATH = f"{encode.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")
SPECIAL = ["", " ", "\n\n  x", "a", "aaaaaaaaaaaaaaa", "don't we'll 'LL", "<|endoftext|>", "é à ü ß", "日本語テキスト", "👩‍👩‍👧 ok", " 　 \t", "x" * 3000, "½ ² Ⅷ ٣", "\r\n \r\n", "á", "�\x00\x7f"]


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    with open(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def enc():
    return encode.Encoder(encode.read_file(PATH))


def some_texts(seed, n=300):
    r = random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "aab ", "0123456789.,- ", "eé àü ß\n", "".join(map(chr, range(32, 600))), "日本語漢字かな ", " \n\t\r "]
    return ["".join(r.choices(r.choice(alphabets), k=r.randint(0, 60))) + " ".join(r.choices(["the", "Court", "'s", "judgment", "don't", "2004"], k=r.randint(0, 8))) for _ in range(n)]


def test_same_as_reference(enc, plain):
    for t in SPECIAL + some_texts(1):
        assert enc.encode(t) == plain.encode_ordinary(t), t
        assert enc.decode(enc.encode(t)) == t.encode()
    assert enc.encode(None) == []


def test_every_token_encodes_to_itself(enc):
    wrong = [i for b, i in enc.id.items() if enc.read(enc.extend(b, [-1])) != [i]]
    assert not wrong


def test_appends_and_edits(enc, plain):
    r = random.Random(2)
    texts = some_texts(3, 60)
    for t in texts:
        doc = encode.Encoded(enc, t)
        for _ in range(6):
            if r.random() < 0.4:
                doc.append(r.choice(texts)[:9])
            else:
                a = r.randint(0, len(doc.text))
                doc.edit(a, min(len(doc.text), a + r.randint(0, 5)), r.choice(["", " ", "x", "ll", "'", "\n", "don't"]))
            assert doc.ids == plain.encode_ordinary(doc.text)


def test_work_stays_near_the_change(enc):
    doc = encode.Encoded(enc, "the court held that " * 500)
    whole = doc.worked
    doc.append("the appeal is dismissed")
    assert 0 < doc.worked < 60
    doc.edit(5000, 5003, "rul")
    assert 0 < doc.worked < 60 < whole
    doc = encode.Encoded(enc, "x" * 1000)
    doc.append("y")
    assert doc.worked == 1


def test_table(spark, plain):
    rows = [(i, t) for i, t in enumerate(SPECIAL)] + [(90, None), (91, ""), (None, "no id"), (0, SPECIAL[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(3))
    got = encode.encode(docs, "doc_id", "text", PATH)
    assert got.columns == ["doc_id", "ids"]
    want = sorted(((i, plain.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert sorted(map(lambda r: (r[0], list(r[1])), got.collect()), key=str) == want
    assert encode.encode(docs.limit(0), "doc_id", "text", PATH).count() == 0


def test_files_of_other_rules_are_refused():
    import json

    with pytest.raises(ValueError, match="Sequence"):
        encode.Encoder(encode.read_file(f"{encode.TOKENIZERS}/word_bpe_49k.json"))
    spec = json.loads(encode.read_file(PATH))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="add_prefix_space"):
        encode.checked(json.dumps(spec).encode())
