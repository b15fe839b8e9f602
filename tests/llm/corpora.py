"""Small texts with the awkward cases, for the tests of this folder."""

import random

SCHEMA = "doc_id long, text string"


def awkward() -> list[tuple]:
    """(doc_id, text): null, empty, blank, one word, non-ASCII, a long word, repeated rows and texts."""
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "word"),
        (5, "Zwei Wörter, ça va? 日本語 😀"),
        (6, "x" * 3000),
        (7, "the same text in two rows. " * 4),
        (8, "the same text in two rows. " * 4),
        (9, "a repeated row"),
        (9, "a repeated row"),
        (10, "line one\nline two\r\nline three\x1c\x85 end"),
        (11, "<|endoftext|> is ordinary text here <|endoftext|>"),
    ]


def prose(n: int, seed: int = 3, low: int = 5, high: int = 150) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeést") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    return [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randrange(low, high))) for _ in range(n)]
