"""Documents with every awkward row: nulls, empty and long texts, repeated rows, ties, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, node long, ids string"
WORDS = {
    "en": "the of and that with ringing stone river over under house thing other whether thought".split(),
    "fr": "le la les que dans avec pour maison rivière être élève château ouvrir jamais toujours".split(),
    "de": "der die das und nicht mit für straße über schön größe haus kirche möchte zwischen".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "er", "ing", "en"]) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def documents(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        text = "\n".join(sentence(rng, lang, rng.randint(8, 40)) for _ in range(rng.randint(1, 6)))
        rows.append((i, text, lang, f"src{i % 4}"))
    long = "\n".join(sentence(rng, "en", 60) for _ in range(400))
    rows += [
        (100, None, "en", "src0"), (101, "", "en", None), (102, " \n\t ", None, None), (103, long, "en", "src1"), (104, "x" * 3000, None, "src2"),
        (105, rows[0][1], "en", "src0"), (105, rows[0][1], "en", "src0"), (None, rows[1][1], "fr", "src1"), (106, rows[3][1] + " ende", "en", None), (107, "12 34 !?", "de", "src3"),
        (108, "déjà vu — naïve “quotes” 日本語 ́ İstanbul \x1c  it's </s> <|endoftext|> ok.", None, "src0"), (109, rows[4][1].replace("a", "a"), "fr", "src1"),
        (110, "the,the.the! don't 'sample' STONE... a, b. c,\n.d", "en", "src2"),
    ]
    return [(*r, len(r[1] or ""), 7, 0.5, 9, "z") for r in rows]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def labels(spark, docs: list[tuple]):
    return spark.createDataFrame([(r[0], int((r[0] or 0) % 5 != 0), 0) for r in docs if r[0] is not None], "doc_id long, quality int, toxic int")
