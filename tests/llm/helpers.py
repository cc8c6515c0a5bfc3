"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, token string, part int, row string, at int"


def docs(spark, texts, first: int = 0):
    """Documents by (doc_id, text) or text, with extra columns whose names are used inside the operators."""
    rows = [t if isinstance(t, tuple) else (first + k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, "x", 2, None, 3) for i, t in rows], DOCS)


def vocabulary(rng: random.Random, n: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(seed: int, n: int = 60) -> list[str | None]:
    """Prose with exact and near copies, shared lines and passages, empty and null texts."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(25) for _ in range(4)]
    out: list[str | None] = []
    for k in range(n):
        lines = [prose(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        text = "\n".join(lines)
        kind = rng.random()
        if out and kind < 0.1:
            text = rng.choice([t for t in out if t] or [text])
        elif out and kind < 0.35:
            base = rng.choice([t for t in out if t] or [text]).split(" ")
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base)
        out.append(text)
    return out + ["", None, "one", "two words", "", out[0], "é" * 30 + " 日本語 " * 20]


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(edges, nodes) -> dict:
    found = {n: n for n in nodes}

    def root(n):
        while found[n] != n:
            n = found[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            found[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
