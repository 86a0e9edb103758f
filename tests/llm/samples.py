"""Texts for the tests of the corpus operators."""


def random_texts(rng, n, words=400, least=0, most=60):
    vocabulary = [f"{'abcdefghij'[i % 10]}w{i}" for i in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(least, most))) for _ in range(n)]


#: Null, empty, blank, one word, controls, a very long text, ties.
ODD = [None, "", " \t\n", "word", "\x0b\x0c", "x " * 30000, "Ünïcode ½ ー 漢字   text", "tie tie", "tie tie", "\x00\x01"]
