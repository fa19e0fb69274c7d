"""Pages written by hand, unlike the layouts the model is trained on, with the exact text they should give."""

import pytest

from rivermark.llm import html_extract

A = "The ferry leaves the harbour every morning at seven, and it returns late in the evening."
B = "Tickets are sold on board. Children travel for free, and bicycles cost two euros."
C = "In winter the crossing takes longer because of the ice, so plan for an extra hour."
MENU = '<nav class="top"><a href="/">Home</a> <a href="/news">News</a> <a href="/shop">Shop</a></nav>'
FOOT = "<footer><p>© 2024 Harbour Times. All rights reserved.</p></footer>"

PAGES = [
    (f"<nav><a href=x>Home</a> <a href=y>Shop</a></nav><article><p>ok text here for reading.</p></article>", "ok text here for reading."),
    (f"<html><body><div>{A}</div><div>{B}</div></body></html>", f"{A}\n{B}"),
    (f"{MENU}<article><h1>Pancakes</h1><p>{A}</p><ul><li>Two eggs</li><li>Flour</li></ul><p>{B}</p></article>{FOOT}", f"Pancakes\n{A}\nTwo eggs\nFlour\n{B}"),
    (f"{MENU}<article><p>{A}</p><dl><dt>Fare</dt><dd>The price of one crossing.</dd></dl></article>{FOOT}", f"{A}\nFare\nThe price of one crossing."),
    (f'<div class="story"><h1>News</h1><p>{A}</p><ul><li>Schools</li><li>Roads</li></ul></div><div class="legal">Terms of use. All rights reserved.</div>', f"News\n{A}\nSchools\nRoads"),
    (f"<main><p>See&nbsp;also AA ©2024</p><p>{A}</p></main>", f"See also AA ©2024\n{A}"),
    (f'<body><header><a href="/">Harbour Times</a></header><main><h1>Ferries</h1><p>{A}</p><p>{B}</p></main>{FOOT}</body>', f"Ferries\n{A}\n{B}"),
    (f'<div id="page"><div id="menu"><ul><li><a href="a">Start</a></li><li><a href="b">Contact</a></li></ul></div><div id="main"><h2>Timetable</h2><p>{A}</p><p>{C}</p></div></div>', f"Timetable\n{A}\n{C}"),
    (f'<article><p>{A}</p><aside class="advert"><p>Buy new shoes today, half price only this week!</p></aside><p>{B}</p></article>', f"{A}\n{B}"),
    (f'{MENU}<article><p>{A}</p><p>{B}</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I took it last year and it was lovely, thank you for writing.</p></div></section>', f"{A}\n{B}"),
    (f'<div class="cookie-banner"><p>We use cookies to improve your visit. By staying you accept them.</p><button>OK</button></div><article><h1>Ferries</h1><p>{A}</p></article>', f"Ferries\n{A}"),
    (f'<article><header><h1>Ferries in winter</h1></header><p>{C}</p></article><form action="/s"><label>Search</label><input name=q><button>Go</button></form>', f"Ferries in winter\n{C}"),
    (f"<html><head><title>x</title><style>p{{}}</style></head><body><script>var a='<p>no</p>';</script><article><p>{A}</p></article></body></html>", A),
    (f'<div class="qopazu"><div class="lurimo"><p>{A}</p><p>{B}</p><p>{C}</p></div></div>', f"{A}\n{B}\n{C}"),
    (f'{MENU}<section class="kupako"><h2>Ferries</h2><div>{A}</div><div>{C}</div></section>{FOOT}', f"Ferries\n{A}\n{C}"),
    (f"<article><p>{A}<br>{B}</p></article>", f"{A} {B}"),
    (f"<article><p>One &lt;tag&gt; &amp; two&#8217;s <em>company</em>, said the captain of the ship.</p><p>{B}</p></article>", f"One <tag> & two’s company, said the captain of the ship.\n{B}"),
    (f"<article><h1>Log</h1><table><tr><th>Day</th><td>Monday</td></tr><tr><th>Wind</th><td>North</td></tr></table><p>{A}</p></article>", f"Log\nDay\nMonday\nWind\nNorth\n{A}"),
    (f"<article><blockquote><p>{A}</p></blockquote><p>{B}</p></article><aside><h3>Related</h3><ul><li><a href=1>Trains</a></li><li><a href=2>Buses</a></li></ul></aside>", f"{A}\n{B}"),
    (f'<main><article><h1>Harbour</h1><p>{A}</p><figure><img src=a><figcaption>The harbour at dawn.</figcaption></figure><p>{C}</p></article></main>{FOOT}', f"Harbour\n{A}\nThe harbour at dawn.\n{C}"),
    (f"{MENU}<article><ol><li>Buy a ticket at the counter.</li><li>Wait for the bell.</li><li>Walk on board.</li></ol></article>", "Buy a ticket at the counter.\nWait for the bell.\nWalk on board."),
    (f'<div class="post"><h1>Diary</h1><p>{A}</p><div class="share"><a href=f>Share</a> <a href=t>Tweet</a></div></div>', f"Diary\n{A}"),
    (f'<div class="wrapper"><div class="sidebar"><p>Subscribe to our newsletter for more.</p></div><div class="entry"><p>{A}</p><p>{C}</p></div></div>', f"{A}\n{C}"),
    (f"<article><p>{A}<p>{B}<p>{C}</article>{FOOT}", f"{A}\n{B}\n{C}"),
    (f"<article><h2>First</h2><p>{A}</p><h2>Second</h2><p>{C}</p></article>", f"First\n{A}\nSecond\n{C}"),
    (f"<body><noscript>Please enable JavaScript to see this page.</noscript><article><p>{A}</p><p>{B}</p></article></body>", f"{A}\n{B}"),
    (f"<article><p>{A}</p><p>Read <a href=x>the timetable</a> before you travel, and <a href=y>the rules</a>, too.</p></article>", f"{A}\nRead the timetable before you travel, and the rules, too."),
    (f'<ul class="menu"><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div class="text"><p>{B}</p></div>', B),
    (f'<div><a href=1><div>Home page</div></a><a href=2><div>Sports page</div></a><a href=3><div>Weather page</div></a></div><article><p>{A}</p></article>', A),
    (f'<article class="post"><h1>Fares</h1><p>{B}</p><p>{C}</p></article><div class="related"><h3>More</h3><a href=1>Trains in summer</a><a href=2>Buses in winter</a></div>', f"Fares\n{B}\n{C}"),
    (f"<table><tr><td><a href=1>Home</a></td><td><a href=2>Map</a></td></tr></table><table><tr><td><p>{A}</p><p>{B}</p></td></tr></table>", f"{A}\n{B}"),
    (f'<main><section><h2>Winter</h2><p>{C}</p></section><section><h2>Summer</h2><p>{A}</p></section></main><footer><ul><li><a href=i>Imprint</a></li></ul></footer>', f"Winter\n{C}\nSummer\n{A}"),
    (f'<article><p>{A}</p></article><div id="footer">Copyright Harbour Times</div>', A),
    (f'<div class="content"><p>{A}</p><div class="ad">Cheap flights to the south, book now.</div><p>{B}</p><p>{C}</p></div>', f"{A}\n{B}\n{C}"),
    (f'<header><h1>Harbour Times</h1><p>Your daily paper</p></header><article><h1>Ice</h1><p>{C}</p></article>', f"Ice\n{C}"),
    ("<nav><a href=1>a</a></nav><footer>© x</footer>", ""),
]


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_named_cases_are_exact(model):
    """Structures whose text was once lost."""
    for source, want in PAGES[:6]:
        assert html_extract.main_text(source, model) == want


def test_precision_and_recall_on_unseen_structures(model):
    kept = right = wanted = exact = 0
    misses = []
    for source, want in PAGES:
        got, need = html_extract.main_text(source, model).split("\n"), want.split("\n")
        got, need = [x for x in got if x], [x for x in need if x]
        hit = sum(x in need for x in got)
        kept, wanted, right, exact = kept + len(got), wanted + len(need), right + hit, exact + (got == need)
        if got != need:
            misses.append((source[:60], [x for x in need if x not in got], [x for x in got if x not in need]))
    assert len(PAGES) >= 30 and right / kept >= 0.97 and right / wanted >= 0.97, (right / kept, right / wanted, misses)


def test_links_around_blocks_and_unclosed_links():
    page = html_extract.parse("<div><a href=1><div>one</div><div>two</div></a><p>three</p></div><p><a href=2>four</p><p>five</p>")
    assert list(zip(page.texts, [n > 0 for n in page.linked])) == [("one", True), ("two", True), ("three", False), ("four", True), ("five", False)]
