"""Small tables with the awkward cases: nulls, empties, ties, repeats, long texts, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, digest string, fp long, node string"


def invented(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "on", "vu", "sa", "ri"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def documents(spark, empty: bool = False):
    rng = random.Random(3)
    texts = [invented(rng, rng.randint(3, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i].upper()) for i in range(10)]  # equal but for case
    rows += [(200 + i, texts[20 + i] + " extra") for i in range(10)]  # near copies
    rows += [(300, None), (301, None), (302, ""), (303, "   \n\t "), (304, "Ä"), (305, "ä"), (None, texts[1]), (None, "alone here"), (306, "one"), (307, "ONE")]
    rows += [(5, texts[5]), (5, texts[5]), (308, "word " * 20_000), (309, "x" * 60_000), (310, "<|endoftext|> and more"), (311, "line a\nline a\n\nline b\r\nline a")]
    long_line = invented(rng, 30)
    rows += [(400 + i, f"{invented(rng, 12)}\n{long_line}{'!' * i}\n{invented(rng, 9)}") for i in range(12)]
    out = [(i, t, "en", [None, "s1", "s2", "Z", "é"][k % 5], len(t or ""), 7, 0.5, "d", 1, "n") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame([] if empty else out, SCHEMA).repartition(3)


def collected(df):
    return [r.asDict() for r in df.collect()]
