"""Documents that every operator on documents must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _m string, rank int, key string, kept string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def passage(seed: int, n: int) -> str:
    """``n`` words that hardly repeat, told apart by the seed."""
    return " ".join(f"{WORDS[(seed + i * 7) % 24]}{(seed * 31 + i) % 97}" for i in range(n))


def row(doc_id, text, source="s", lang="en"):
    """A document with extra columns whose names operators use themselves."""
    return (doc_id, text, lang, source, len(text or ""), "extra", "extra", 1, "k", "no")


#: Nulls in any column, empty and blank texts, ties, repeated rows, a very long text and odd characters.
ODD = [
    row(1, None), row(2, ""), row(3, " \t\n "), row(None, passage(1, 60)), row(4, passage(2, 60), None, None), row(5, "one"), row(5, "one"), row(6, "a b c"),
    row(7, passage(2, 60)), row(8, "\n".join(passage(3, 60) for _ in range(3))), row(9, passage(4, 40_000)), row(10, "ÄÖ é 漢字 😀 \u0085 x y " + passage(5, 50)),
    row(11, "\n".join(passage(i, 9) for i in range(300))), row(12, None, None, None), row(None, None, None, None),
]
