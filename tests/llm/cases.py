"""Documents with all that may go wrong in one table."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000)) + "\n" + "x" * 50_000
TEXTS = [None, "", "   \n\t\n", "one two three", "One  two\tthree.", "a" * 3000, "é ß 日本語 \U0001f600 Ω", LONG, "line one here\nline two there\n\nline one here", "one two three"]


def documents(spark, texts=TEXTS, ids=None):
    """doc_id, text and extra columns whose names the operators use themselves."""
    ids = ids or [*range(len(texts) - 1), None]
    rows = [(i, t, None if k % 2 else "en", "src0", k, k, "x", 1.0) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, `row` long, n_deleted string, score double")


def empty(spark):
    return documents(spark).where("false")
