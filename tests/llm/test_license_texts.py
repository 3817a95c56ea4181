"""Scanning against aligning the whole text, and texts with foreign words in them."""

import random

import pytest

from tallyframe.llm import licenses


def spread(text, every, rnd):
    """A foreign word after each so many words."""
    out = []
    for k, w in enumerate(text.split(), 1):
        out.append(w)
        if k % every == 0:
            out.append("q" + "".join(rnd.choice("xzvk") for _ in range(6)))
    return " ".join(out)


@pytest.mark.parametrize("every", [1, 2, 5])
@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_foreign_words_lose_nothing(name, every):
    scan = licenses.Scanner(licenses.TEMPLATES)
    text = f"before it {spread(licenses.TEMPLATES[name], every, random.Random(every))} and after it"
    own = scan.templates[name]
    whole = len(licenses.align(licenses.words(text), own)) / len(own)  # alignment goes by words that are unique in both, so 1 is not certain
    found = {n: c for n, c, _, _ in scan(text)}
    assert whole > 0.95 and found.get(name, 0) >= round(whole, 6)


def test_scan_reaches_the_whole_alignment():
    """Whatever aligning a whole text finds, the scanner finds: that template, or one that has more words of it aligned."""
    scan = licenses.Scanner(licenses.TEMPLATES)
    rnd = random.Random(3)
    names = sorted(licenses.TEMPLATES)
    for _ in range(400):
        name = rnd.choice(names)
        words = licenses.TEMPLATES[name].split()
        for _ in range(rnd.randint(0, len(words) // 8)):
            k = rnd.randrange(len(words))
            words[k : k + 1] = rnd.choice(([], ["zzq"], [words[k], "zzq", "vvq"]))
        text = " ".join(["filler"] * rnd.randint(0, 60) + words + ["filler"] * rnd.randint(0, 60))
        tokens = licenses.words(text)
        own = scan.templates[name]
        pairs = licenses.align(tokens, own)
        if len(pairs) < scan.least * len(own) or not scan.telling[name] <= {j for _, j in pairs}:
            continue
        found = scan(text)
        aligned = max((round(c * len(scan.templates[n])) for n, c, _, _ in found), default=0)
        assert aligned >= len(pairs), (name, found)


def test_whole_texts_and_repeats():
    scan = licenses.Scanner(licenses.TEMPLATES)
    text = licenses.TEMPLATES["MIT-text"]
    assert [n for n, _, _, _ in scan(text)] == ["MIT-text"]
    many = scan("\n\n".join([text, licenses.TEMPLATES["Zlib-text"], text, spread(text, 2, random.Random(1))]))
    assert [n for n, _, _, _ in many] == ["MIT-text", "Zlib-text", "MIT-text", "MIT-text"]
    assert [c for _, c, _, _ in many[:3]] == [1.0, 1.0, 1.0] and many[3][1] > 0.95


def test_long_text_of_template_words_is_soon_done():
    scan = licenses.Scanner(licenses.TEMPLATES)
    rnd = random.Random(4)
    words = sorted(scan.vocabulary)
    assert isinstance(scan(" ".join(rnd.choice(words) for _ in range(20_000))), list)
