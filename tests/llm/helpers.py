from __future__ import annotations

import random

VOWELS = "aeiou"


def word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprst") + rng.choice(VOWELS) for _ in range(rng.randint(1, 4)))


def prose(rng: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(word(rng) + (rng.choice([". ", ".\n", ", "]) if i % 9 == 8 else " "))
    return "".join(out).strip()


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split(" ")
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = word(rng)
    return " ".join(words)
