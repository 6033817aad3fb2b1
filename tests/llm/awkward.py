"""Rows that every operator on documents must take."""

LONG = " ".join(f"word{i} and{i % 97}" for i in range(40_000))
AWKWARD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \t\n\x0b\f\r ", "en", None), (4, "one", None, "s"),
    (5, LONG, "en", "t"), (6, LONG, "en", "t"), (7, "same row twice here", "en", "s"),
    (7, "same row twice here", "en", "s"), (None, "no id at all", "en", "s"), (None, None, None, None),
    (8, "same id other text", "de", "s"), (8, "yet another text for it", "de", "s"), (9, "é😀 ünï 日本", "fr", "u"),
]
