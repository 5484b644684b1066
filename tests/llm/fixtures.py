"""Small inputs with every awkward case."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that for it on was with be as by are this at from her his stone river quiet lantern seven".split()


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(state >> 8) % len(WORDS)] + ("" if (state >> 4) % 5 else chr(97 + (state >> 12) % 26)))
    return " ".join(out)


def documents(spark, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward() -> list:
    """Null, empty, blank, tiny, repeated, very long and non-ASCII texts."""
    base = prose(3, 400)
    return [None, "", "  \n\t ", "one", "one two", base, base, base.replace("stone", "Stone"), base + " extra tail words", prose(9, 30_000), "x" * 100_000, "éèà ñ ß 漢字 \x1c\x85 a\x00b", "a\nb\na\n\n\nb\na", prose(11, 50) + "\n" + prose(11, 50)]
