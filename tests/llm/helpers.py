"""Small tables with every awkward row."""

import contextlib
from unittest import mock

from pyspark import cloudpickle

NASTY = [
    None,
    "",
    " ",
    "\n",
    "\n\n",
    "a",
    "Ünï cödé",
    "\x00\x01 x",
    "🙂 " * 30,
    "word " * 40,
    "x" * 5000,
    "line one that is long enough\nline one that is long enough\nline one that is long enougt",
]


def documents(spark, texts, *, ids=None, extra=True):
    """``documents`` with clashing extra columns."""
    rows = [(i if ids is None else ids[i], x, "en" if i % 2 else "de", f"src{i % 3}", None if x is None else len(x), i, float(i), [i], "k") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, hits double, items array<int>, key string")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def empty(spark):
    return documents(spark, ["x"]).limit(0)


@contextlib.contextmanager
def set_in_tasks(module, **values):
    """Constants of a module replaced, here and in tasks, to which its functions are sent by value."""
    cloudpickle.register_pickle_by_value(module)
    try:
        with mock.patch.multiple(module, **values):
            yield
    finally:
        cloudpickle.unregister_pickle_by_value(module)
