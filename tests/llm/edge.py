"""Documents with everything that may go wrong: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, dk long, th long, score double"


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "ö") for b in ("ta", "pe", "si", "du", "x", "")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    passage, page = prose(60), prose(150)
    texts = [
        None, "", " \t\n", "one", "One word less", "a b c d e", "a\x0bb\x0cc d\x1ce", passage, prose(40) + "\n" + passage, passage + "\n" + prose(45),
        page, page, page + " more", page.upper(), "x" * 5000, "ab " * 3000, prose(4000), prose(30) + "\n" + prose(30) + "\n" + prose(30),
        "the same line here\n" + prose(60), "the same line here\n" + prose(61), "▁ <s> \u0000 � 😀 é ﬁ", "İstanbul ẞ ǅ",
    ]
    words = page.split()
    for k in range(12):  # near copies
        changed = list(words)
        changed[rng.randrange(len(changed))] = f"w{k}"
        texts.append(" ".join(changed))
    out = [(i * 7 % 97, t, rng.choice(["en", None]), rng.choice(["a", "b", "c", None]), None, 5, 6, 7, 0.5) for i, t in enumerate(texts)]
    out.append(out[10])  # a row twice
    out.append((None, page, None, None, None, None, None, None, None))
    out.append((None, prose(80), None, None, None, None, None, None, None))
    return out


def unique(seed: int = 3) -> list[tuple]:
    """The same with one row for each doc_id, which is never null."""
    seen: dict = {}
    for r in rows(seed):
        if r[0] is not None:
            seen.setdefault(r[0], r)
    return list(seen.values())
