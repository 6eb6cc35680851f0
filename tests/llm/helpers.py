"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

import random

WORDS = "the of and to in river stone cloud market paper light green seven table under garden winter song bridge".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "ed", ","]) + str(r.randint(0, 99)) * (r.random() < 0.3) for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"edit{r.randint(0, 999)}"
    return " ".join(words)


def awkward_texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(1, 120), prose(2, 90)
    passage = prose(3, 60)
    rows = [(1, base), (2, base), (3, edited(base, 5, 2)), (4, edited(base, 6, 4)), (5, other), (6, None), (7, ""), (8, "   \n\t "),
            (9, "one two three"), (10, "One  TWO three"), (11, "one two three four"), (12, "ÉCOLE école ÉCOLE"), (13, "école"),
            (14, prose(4, 6000)), (15, passage + " " + prose(5, 200)), (16, passage + " " + prose(6, 30)), (17, passage),
            (18, other.upper()), (19, other), (19, other), (20, "x" * 5000), (None, base), (None, "lonely words without any key here")]
    rows += [(100 + i, edited(base, 50 + i, i % 7)) for i in range(40)]
    rows += [(200 + i, prose(300 + i, 40 + i)) for i in range(30)]
    return rows


def documents(spark, rows=None):
    """With extra columns that share names with the operators' own."""
    rows = awkward_texts() if rows is None else rows
    data = [(k, t, "en", f"src{i % 3}", None if t is None else len(t), 1.5, "x", i) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(
        data, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, n int"
    )


def save(tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
