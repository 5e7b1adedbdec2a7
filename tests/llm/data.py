"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, root int, key binary, text_length int"


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    base = random.Random(0)
    words = ["".join(base.choice("bcdfglmnprst") + base.choice("aeiou") for _ in range(base.randint(2, 4))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


def rows():
    a, b = prose(1, 60), prose(2, 80)
    near = a.split()
    near[30] = "changed"
    texts = {
        1: a, 2: a, 3: " ".join(near), 4: b, 5: None, 6: "", 7: " \n\t ", 8: "one two", 9: "ONE  two", 10: prose(3, 20_000), 11: prose(4, 5),
        12: "write to jo.do@mail.example.com or +1 (415) 555-0132 from 10.0.0.7, card 4539148803436467", 13: "Ünïcödé \U0001f600 text\x00 <|endoftext|> x", 14: "word" * 3000,
    }
    out = [(i, t, "en", "s", None if t is None else len(t), "c", 1, b"k", 0) for i, t in texts.items()]
    return [*out, out[0], (None, a, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
