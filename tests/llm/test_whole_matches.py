"""Corpus operators report whole values, against brute force."""

import random
import re

from recordlake.llm import decontaminate, secret_scan


def longest_match(text, item, width):
    """Longest common run of words that holds a window of the item."""
    a, b = (re.findall("[0-9a-z]+", x.lower()) for x in (text, item))
    need = min(width, len(b))
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        above = [0] + [above[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *above)
    return best if b and best >= need else 0


def test_op1_longest_is_the_whole_match(spark):
    rng = random.Random(3)
    some = lambda n: [rng.choice("abc") + str(rng.randrange(30)) for _ in range(n)]
    items = [some(300), some(50), ["r"] * 40, some(4), some(12)]
    items.append(items[0][:100] + some(20))
    texts = [some(9) + items[0][k : k + n] + some(30) for k, n in ((0, 300), (3, 120), (250, 50), (7, 27), (7, 28), (40, 10), (40, 9))]
    texts += [items[1], ["r"] * 35, ["r"] * 60, items[3] + items[4] + items[3], some(200), [], items[1][:30] + some(1) + items[1][30:]]
    bench = [" ".join(i) for i in items]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    table = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    want = [max(longest_match(" ".join(t), i, 10) for i in bench) for t in texts]
    assert want[:7] == [300, 120, 50, 27, 28, 10, 0] and max(want[7:]) == 50
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.find_matches(docs, table, block_bytes=block).orderBy("doc_id").collect()
        assert [r["longest"] for r in got] == want


def test_op3_values_of_seven_characters():
    spans = lambda text: [text[a:b] for a, k, b in secret_scan.scan_text(text) if secret_scan.KINDS[k] == "guess"]
    assert spans("pwd=kX9#vQ2 passphrase: aB3$xY9 auth=abc12% x") == ["kX9#vQ2", "aB3$xY9"]
    for word in ("secrets", "auth", "password", "private_keys"):
        assert spans(f"pwd: {word} = kX9#vQ2!mZ7p") == ["kX9#vQ2!mZ7p"]


def test_op3_repeats_are_counted_to_their_end():
    unit = "kX9#vQ2!mZ7p"
    whole = secret_scan.log_guesses(unit) + 3
    assert all(secret_scan.log_guesses(unit * n) <= whole for n in (2, 15, 30, 300, 900))


def every_segmentation(value, words):
    """The least cost over all ways to cut a value, each part priced by itself."""
    import math

    single = secret_scan._alphabet(value)

    def price(i, j):
        part, low = value[i:j], value[i:j].lower()
        out = [single] if j - i == 1 else []
        if j - i >= 3 and len(set(part)) == 1:
            out.append(single + math.log10(j - i))
        if j - i >= 4 and all(low[k : k + 2] in secret_scan._NEXT for k in range(j - i - 1)):
            out.append(math.log10(47) + math.log10(j - i))
        for form in {low, low.translate(secret_scan._LEET)}:
            if form in words and j - i >= 3:
                out.append(math.log10(words[form] * (j - i + 1 if part not in words else 1) + 1))
        for pattern, cost in secret_scan._DATES:
            if pattern.fullmatch(part):
                out.append(cost)
        for unit in range(2, i + 1):  # repeats of the unit, no repeat itself, that ends where the part begins
            whole = value[i - unit : i]
            if (whole + whole).find(whole, 1) == unit and (j - i) % unit == 0 and part == value[i - unit : i] * ((j - i) // unit):
                out.append(math.log10((j - i) // unit + 1))
        return min(out, default=math.inf)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + price(i, j) for i in range(j)))
    return best[-1]


def test_op3_cost_is_the_least_of_all_segmentations():
    rng = random.Random(8)
    words = secret_scan.ranks(secret_scan.COMMON_WORDS)
    pieces = ["pass", "werty", "word", "p4ss", "aaaa", "20231231", "1999", "qwer", "xk", "Z", "31-12-2020", "abcabc", "!", "dragon", "12345"]
    for _ in range(150):
        value = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        assert abs(secret_scan.log_guesses(value, words) - every_segmentation(value, words)) < 1e-9
    cost = secret_scan.log_guesses
    assert cost("passwerty") <= cost("pass") + cost("werty") + 1e-9
    unit = "kX9#vQ2!mZ7pLw4@tR8$yB1%nC6^hD"
    assert cost(unit * 2) < cost(unit) + 1
    assert cost("elephantchocolate", secret_scan.ranks(["elephant", "chocolate"])) < 2


def test_op3_dictionary_and_clashing_names(spark):
    rows = [(1, "passphrase: elephantchocolate", "x"), (2, None, "y"), (3, "elephant elephant chocolate é elephantine", "z"), (3, "elephant elephant chocolate é elephantine", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    assert secret_scan.corpus_words(docs, 2) == ["elephant", "chocolate"]
    plain = {r["doc_id"]: r["n_guess"] for r in secret_scan.scan(docs, ["doc_id"]).collect()}
    known = secret_scan.scan(docs, ["doc_id", "spans"], dictionary=["elephant", "chocolate"])
    assert known.columns[:2] == ["doc_id", "spans_"] and plain[1] == 1 and {r["n_guess"] for r in known.collect()} == {0}
    assert known.count() == 4
