"""Row folds and selections against cases worked out by hand and plain replays."""

import itertools
import math
import random

import pytest

from cutroom.functions import text as x
from cutroom.operators import match

LONG = "This one is a sentence of over twenty-five signs"


@pytest.mark.parametrize(("text", "want"), [
    ("Short. Tiny! " + LONG + ". End", ["Short. Tiny", LONG, "End"]),
    (LONG + "? " + LONG, [LONG, LONG]),
    ("a. b", ["a. b"]), ("", []), ("...", []),
    (", ".join(["word" * 15] * 4), [", ".join(["word" * 15] * 2)] * 2),
    ("x" * 160 + ", tail", ["x" * 160, "tail"]),
    ("Hi. " + "y" * 149, ["Hi", "y" * 149]),
])
def test_segments_by_hand(spark, text, want):
    got = x.segment_script(spark.createDataFrame([(1, text)], "k int, text string")).orderBy("pos").collect()
    assert [r["segment"] for r in got] == want


@pytest.mark.parametrize(("text", "most", "want"), [
    ("aaa bbb ccc ddd", 10, ["aaa bbb", "ccc ddd"]), ("aa, bb cc dd", 10, ["aa bb cc", "dd"]), ("abcdefg, hi jk", 10, ["abcdefg", "hi jk"]), ("abcdefg, hi jk", 11, ["abcdefg hi", "jk"]),
    ("abcdef gh", 4, ["abcdef", "gh"]), ("aaa bbb ccc ddd eee fff", 7, ["aaa bbb", "ccc ddd"]), (", ,", 9, []), ("one", 9, ["one"]),
])
def test_wrapped_lines_by_hand(spark, text, most, want):
    got = x.wrap_lines(spark.createDataFrame([(1, text)], "k int, text string"), most_chars=most).orderBy("pos").collect()
    assert [r["line"] for r in got] == want


def test_word_layout_by_hand(spark):
    rows = [(1, ["One", "two,", "x", "three!"], ["one TWO", "Three"]), (2, ["a", "b"], ["zzz a"]), (3, ["a", "a", "b"], ["a", "", "b a"]), (4, [], ["a"])]
    got = x.caption_word_layout(spark.createDataFrame(rows, "k int, words array<string>, lines array<string>")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 3, 1, 0), (3, 0, 0, 0), (3, 2, 2, 0)]


def test_caption_and_phrase_groups_by_hand(spark):
    words = ["a", "b,", " ", "c", "d", "e", "f", "g" * 50, "h" * 40, "i", "j.k"]
    rows = [(1, i, w, float(i), i + 0.5) for i, w in enumerate(words)] + [(2, 0, "\n", 0.0, 1.0)]
    got = x.caption_groups(spark.createDataFrame(rows, "k int, i int, word string, start double, end double"), ["k"], "i").orderBy("group").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.0, 1.5, "a b,"), (1, 1, 3.0, 6.5, "c d e f"), (1, 2, 7.0, 8.5, f"{'g' * 50} {'h' * 40}"), (1, 3, 9.0, 10.5, "i j.k")]
    units = [["so", "it", "is", "here", ",", "now", "!", "a,", "b", "c", "d", "e", "f", "g", "h", "i"], ["a unit that is long", "and one more of that"], [], ["only"]]
    got = x.phrase_groups(spark.createDataFrame(list(enumerate(units)), "k int, units array<string>")).orderBy("k", "pos").collect()
    assert [(r["k"], r["phrase"]) for r in got] == [(0, "so it is here,"), (0, "now!"), (0, "a, b c d e f g h"), (0, "i"), (1, units[1][0]), (1, units[1][1]), (3, "only")]


def scores(rng, segments, media):
    return {(s, m): rng.choice([-0.2, 0.1, 0.3, 0.3, 0.5, 0.7, 0.9]) for s in range(segments) for m in range(media)}


def test_ranking_takes_the_best_unused_item(spark):
    rng = random.Random(2)
    cases = {k: scores(rng, rng.randrange(1, 9), rng.randrange(1, 7)) for k in range(12)}
    got = match.rank_media_for_script(spark.createDataFrame([(k, s, m, v) for k, c in cases.items() for (s, m), v in c.items()], "k int, seg_idx int, media_idx int, sim double"), "k")
    for k, case in cases.items():
        media, order = sorted({m for _, m in case}), []
        for s in sorted({s for s, _ in case}):
            choice = [m for m in media if m not in order] or [m for m in media if m != order[-1]] or media
            order.append(max(choice, key=lambda m: (case[s, m], m)))
        order += [m for m in media if m not in order]
        assert [r["media_idx"] for r in got.where(f"k = {k}").orderBy("pos").collect()] == order


def test_clips_equal_a_replay(spark):
    rng = random.Random(4)
    combos = list(itertools.product((1, 2, 3), (3, 5, 12)))
    cases = {k: (scores(rng, rng.randrange(1, 5), n), float(rng.randrange(9, 60))) for k, (_, n) in enumerate(combos)}
    sims = spark.createDataFrame([(k, s, m, v) for k, (c, _) in cases.items() for (s, m), v in c.items()], "k int, seg_idx int, media_idx int, sim double")
    audio = spark.createDataFrame([(k, a) for k, (_, a) in cases.items()], "k int, audio_s double")
    for reuse in (1, 2, 3):
        got = match.select_clips_for_script(sims, audio, "k", 4.0, reuse).collect()
        for k, (case, seconds) in cases.items():
            media, segments, need = sorted({m for _, m in case}), sorted({s for s, _ in case}), math.ceil(seconds / 4)
            limit = reuse if need <= len(media) else math.ceil(need / len(media)) if reuse == 1 else min(math.ceil(need / len(media)), reuse)
            used, want = dict.fromkeys(media, 0), []
            for clip in range(need):
                def worth(m):
                    if limit == 1:
                        return case[s, m] - (0 if not used[m] else 0.3 if all(used.values()) else 1)
                    return case[s, m] - (0.2 * used[m] if used[m] < min(limit, 4) else 1)

                s = segments[clip % len(segments)]
                first = max(media, key=lambda m: (worth(m), -m))
                if worth(first) > 0:  # the best one
                    pick = first
                else:  # the first that is allowed at all: one below zero gives way to no other that is
                    pick = next((m for m in media if worth(m) > -1), None)
                    better = [m for m in media if pick is not None and worth(m) > worth(pick)]
                    pick = max(better, key=lambda m: (worth(m), -m)) if better and worth(pick) < 0 else pick
                if pick is not None:
                    used[pick] += 1
                    want.append((clip, s, pick))
            assert sorted((r["clip"], r["seg_idx"], r["media_idx"]) for r in got if r["k"] == k) == want, (reuse, k)
