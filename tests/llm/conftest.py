import pytest

LONG = "lorem ipsum dolor " * 9000
TRICKY = [
    "",
    None,
    " ",
    "\n\n \t",
    "one",
    "One TWO three\x0bfour\x0cfive\rsix",
    "a b\u00a0c \u3000d  e",
    "same words again " * 30,
    "same words again " * 30,
    "tab\tnew\nline # * $ % & | < >\nline # * $ % & | < >\n\nline # * $ % & | < >",
    "caf\u00e9 \u00c9COLE na\u00efve \u65e5\u672c\u8a9e \U0001f600 z\u0301",
    "<s>[INST] hi [/INST]</s> <|endoftext|> <|im_start|> \\ \\\\",
    "trailing ",
    "  leading and   inner   runs ",
    "\u2581marks \u2581 inside\u2581",
    "nul\0byte",
    LONG,
]


@pytest.fixture(scope="session")
def tricky(spark):
    """Null ids, texts and sources, repeated rows, and columns named like results and internals."""
    rows = [(i, t, "en", [None, "b", "a", "b"][i % 4], i, "x", 1.5, "y") for i, t in enumerate(TRICKY)]
    rows += [rows[6], (None, "no id", "en", "a", 1, "x", 1.5, "y"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, target double, n_tokens string").repartition(3)
