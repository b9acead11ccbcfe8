"""Links of repeated rows, and text around named inline elements."""

import pytest
from test_edges import linked_by_force

from segq.llm import html_text, ngram_join


def test_ngram_join_of_rows_that_are_all_repeated(spark):
    """Hubs of five shingles and two texts that link with the hub alone, by
    entries of their own."""
    rows = []
    for k in range(30):
        words = [f"w{k}x{j}" for j in range(9)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[1:])), (3 * k + 2, " ".join(words[:-1]))]
    _, find = linked_by_force(rows)
    for times in (2, 3):
        table = spark.createDataFrame(rows * times, "doc_id long, text string").repartition(3)
        got = ngram_join.ngram_join(table).collect()
        assert len(got) == times * len(rows) and {(r.doc_id, r.component_id) for r in got} == {(i, find(i)) for i, _ in rows}


def test_ngram_join_of_an_id_with_two_texts(spark):
    """An id whose two texts also stand under smaller ids joins both groups."""
    one, two = (" ".join(f"{c}{i}" for i in range(12)) for c in "ab")
    rows = [(1, one), (2, two), (9, one), (9, two), (9, one), (4, two + " end"), (5, "other words only here now"), (None, one), (None, two)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (9, 1), (4, 1), (5, 5), (None, None)} and len(got) == len(rows)


P = "the cat is on the mat and it was " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><p>{P}</p><span class="share">3</span> tail <p>more</p></article>', [P, "tail", "more"]),
        (f'<article><p>{P}<em class="ad">3 <em>4</em> 5</em>tail</p><p>more</p></article>', [P + "tail", "more"]),
        (f'<p>{P}<small id="legal">x</small> short tail</p>', [P + " short tail"]),
        (f'<article><p>{P}<svg class="share" />tail</p><p>more</p></article>', [P + "tail", "more"]),
        (f'<article><span class="social"><div>a</div>b</span> tail <p>{P}</p></article>', ["tail", P]),
        (f'<article><p>{P}<span class="share">3</p><p>more</p></article>', [P, "more"]),
        (f'<article><p>{P}</p><div class="ad">a<span>b</span>c</div><p>more</p></article>', [P, "more"]),
    ],
)
def test_inline_elements_drop_only_their_own_text(page, want):
    assert html_text.main_text(page).split("\n") == [" ".join(x.split()) for x in want]
