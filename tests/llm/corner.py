"""Rows that every operator must cope with: nulls, empty and long texts, repeated rows, clashing column names."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
CLASHING = ["key", "size", "hash", "node", "place", "line", "doc", "spans", "bucket", "range", "text_key", "taken", "block"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, n: int) -> str:
    made = random.Random(seed)
    return " ".join(made.choice(WORDS) + str(made.randrange(50)) for _ in range(n))


def documents(spark):
    shared = "this line is shared by all the documents"
    passage = prose(99, 30)
    texts = [
        (0, None), (1, ""), (2, " \n\t\n"), (3, "one"), (4, f"{prose(4, 60)}\n{shared}\n{passage}"),
        (5, f"{prose(5, 60)}\n  {shared.upper()} \n{passage} end"), (6, f"{shared}\n{prose(6, 40)}\n{shared}"),
        (7, prose(7, 20_000)), (8, prose(7, 20_000)), (9, prose(9, 80)), (9, prose(9, 80)), (9, prose(10, 80)),
        (None, prose(9, 80)), (None, None), (10, prose(11, 200)), (11, prose(11, 199) + " changed"), (12, "日本 ñandú É\n" + shared),
        (13, passage), (14, passage + "\n" + passage),
    ]
    rows = [
        (i, t, [None, "en", "fr"][(i or 0) % 3], [None, "a", "b"][(i or 0) % 3], None if t is None else len(t), *CLASHING)
        for i, t in texts
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    """Documents as Python rows."""
    return [(r["doc_id"], r["text"]) for r in df.collect()]
