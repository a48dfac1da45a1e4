import math
import random

import numpy as np

from tessera.llm import html_text


def words(n, at=0):
    return " ".join(f"word{at + k}" for k in range(n))


def test_pages_without_landmarks_keep_sibling_sections():
    a, b = words(460), words(40, 500)
    assert html_text.main_text(f"<body><div>{a}</div><div>{b}</div></body>") == f"{a}\n{b}"
    sections = [words(200, 1000 * k) for k in range(4)] + ["Short."]
    page = "<body><div class=nav>menu</div><div>" + "".join(f"<section><p>{s}</p></section>" for s in sections) + "</div><div class=footer>foot</div></body>"
    assert html_text.main_text(page) == "\n".join(sections)


def test_pages_without_landmarks_keep_a_heading_and_a_list_outside():
    a, b = words(300), words(300, 500)
    page = f"<body><nav>menu</nav><h1>Head</h1><div><p>{a}</p><p>{b}</p></div><ul><li>one</li><li>two</li></ul><footer>foot</footer></body>"
    assert html_text.main_text(page) == f"Head\n{a}\n{b}\none\ntwo"


def test_pages_without_landmarks_still_go_down_to_the_content():
    a, b = words(300), words(300, 500)
    page = f"<body><div><p>x</p></div><div><h2>Head</h2><p>{a}</p><p>{b}</p></div><div></div><div><p>{'<b>y</b>' * 9}</p><p><i><b>z</b></i></p></div></body>"
    assert html_text.main_text(page) == f"Head\n{a}\n{b}"


def test_class_names_are_read_as_whole_names():
    a, b = words(100), words(80, 500)
    assert html_text.main_text(f'<body><div class="layout no-sidebar"><p>{a}</p><p>{b}</p></div></body>') == f"{a}\n{b}"
    assert html_text.main_text(f'<article><p>{a}</p><div class="share-price"><p>{b}</p></div></article>') == f"{a}\n{b}"
    assert html_text.main_text(f"<article><p>{a} <math><mi>x</mi></math></p></article>") == f"{a} x"
    for name in ("sidebar", "left-sidebar", "ad-slot-2", "comments-list", "site_footer", "cookie-notice", "related-posts", "share-buttons"):
        assert html_text.main_text(f'<body><div class="{name}">{words(9)}</div><p>{a}</p><div id="{name}">x</div></body>') == a, name
    # Furniture that holds most of the content is none.
    assert html_text.main_text(f'<body><div class="sidebar">small</div><div id="widget"><p>{a}</p><p>{b}</p></div></body>') == f"{a}\n{b}"


def test_the_clusters_choose_between_landmark_and_page(monkeypatch):
    a, b = words(150), words(120, 500)
    links = "".join(f"<div><a>w{k}</a><i></i><b></b> <a>link{k}</a></div>" for k in range(200))
    page = f"<body><div><h2>Head</h2><p>{a}</p><p>{b}</p></div><main>{links}</main></body>"
    assert html_text.main_text(page) == f"Head\n{a}\n{b}"  # the main element holds links only
    assert html_text.main_text(f"<body><p>{words(60, 900)}</p><article><h1>H</h1><p>{a}</p><p>{b}</p></article></body>") == f"H\n{a}\n{b}"
    monkeypatch.setattr(html_text, "content", lambda lines: (np.ones(len(lines), bool), 0.0))
    assert html_text.main_text(page) != f"Head\n{a}\n{b}"


def test_smoothing_and_clusters_against_plain_versions():
    rng = random.Random(9)
    for _ in range(200):
        x = np.array([rng.choice([1, 2, 5, 40, 90]) * rng.random() for _ in range(rng.randint(1, 30))])
        want = []
        for i in range(len(x)):
            w = [(math.exp(-0.5 * (j - i) ** 2), x[j]) for j in range(max(0, i - 2), min(len(x), i + 3))]
            want.append(sum(p * q for p, q in w) / sum(p for p, _ in w))
        got = html_text.smooth(x)
        assert np.allclose(got, want)
        high, cut = html_text.content_cluster(got)
        assert (high == (got >= cut)).all()
        assert high.any()
        if not high.all():  # the cut is in the middle of the means, and the clusters do not mix
            assert got[high].min() > got[~high].max()
            middle = (got[high].mean() + got[~high].mean()) / 2
            assert got[~high].max() < middle + 1e-6 and got[high].min() >= middle - 1e-6


def test_ratios_count_a_lines_own_tags():
    parser = html_text.Lines()
    parser.feed("<div><p>four</p><p><b>ab</b><i>cd</i></p></div>")
    parser.close()
    assert [x.text for x in parser.lines] == ["four", "abcd"]
    assert html_text.ratios(parser.lines)[0] > html_text.ratios(parser.lines)[1]
