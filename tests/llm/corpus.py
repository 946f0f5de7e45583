"""A small corpus with the awkward cases, and helpers."""

import random

SYLLABLES = "an ba co di el fu gar hi is jo ka lum ne or pa qui ra st te un va wo xi ye zo".split()
TEXT_SCHEMA = "doc_id long, text string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def paragraph(rng, lines=6, words=15):
    return "\n".join(sentence(rng, words).capitalize() + "." for _ in range(lines))


def awkward(seed=1):
    """Texts: copies, near copies, shared passages, short, empty, null, repeated rows, a very long one."""
    rng = random.Random(seed)
    base = [paragraph(rng) for _ in range(12)]
    passage = paragraph(rng, 5, 14)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, base[1].replace("a", "A", 1) + " end"), (23, base[2] + "\n" + sentence(rng, 3))]
    rows += [(24, base[3] + "\n" + passage), (25, passage + "\n" + paragraph(rng, 2)), (26, paragraph(rng, 1) + "\n" + passage + "\n" + passage)]
    rows += [(30, ""), (31, None), (32, " \n\t "), (33, "one"), (34, "two words"), (35, "\n\n\n"), (36, "short line\n")]
    rows += [(40, base[4]), (40, base[4]), (41, paragraph(rng, 400, 12)), (42, "z" * 5000), (43, "z" * 5000), (44, "ab " * 900), (None, base[5])]
    return rows


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
