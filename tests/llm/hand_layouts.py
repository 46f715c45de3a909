"""Page layouts written by hand, for tests alone: (name, html, main text). No training page looks like them."""

P = [
    "The ferry left the harbour at six, and by noon the islands were a thin grey line behind us.",
    "Nobody on board had slept much. The cook made coffee twice, and the second pot was better than the first.",
    "By evening the wind had turned to the south, and the captain said that we would reach the coast before dawn.",
]
TITLE = "A crossing in spring"
TEXT = "\n".join([TITLE, *P])
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in P)

LAYOUTS = [
    ("nameless divs", f'<html><body><div id="top"><a href="/">Harbour News</a></div><div id="c1"><h1>{TITLE}</h1>{PARAGRAPHS}</div><div id="bottom">Copyright 2020</div></body></html>', TEXT),
    ("bare body", f"<html><body><h1>{TITLE}</h1>{PARAGRAPHS}</body></html>", TEXT),
    ("bare body, open tags", f"<h1>{TITLE}</h1>" + "".join(f"<p>{p}" for p in P), TEXT),
    ("article with a table", f'<body><nav><a href="/">Home</a> <a href="/a">About</a></nav><article><h1>{TITLE}</h1><p>{P[0]}</p><table><tr><td>Departure of the morning ferry from the northern pier</td></tr></table><p>{P[1]}</p></article></body>', f"{TITLE}\n{P[0]}\nDeparture of the morning ferry from the northern pier\n{P[1]}"),
    ("main with comments", f'<body><header>Harbour News</header><main><h1>{TITLE}</h1>{PARAGRAPHS}</main><div class="comments"><div class="comment"><p>I liked the part about the coffee, thank you for writing it.</p></div></div><footer>All rights reserved</footer></body>', TEXT),
    ("article with form and aside", f'<body><article><h1>{TITLE}</h1><p>{P[0]}</p><form><label>Your address</label><input><button>Subscribe</button></form><p>{P[1]}</p><aside><p>More stories from the coast</p></aside><p>{P[2]}</p></article></body>', TEXT),
    ("sidebar by class", f'<body><div class="page"><div class="sidebar"><h3>Topics</h3><ul><li><a href="/t">Travel</a></li><li><a href="/f">Food</a></li></ul></div><div class="content"><h1>{TITLE}</h1>{PARAGRAPHS}</div></div></body>', TEXT),
    ("layout table", f'<body><table><tr><td width=120><a href="/">Start</a><br><a href="/map">Map</a></td><td><h2>{TITLE}</h2>{PARAGRAPHS}</td></tr></table></body>', TEXT),
    ("cookie notice first", f'<body><div class="cookie-notice"><p>We use cookies to improve your visit.</p><button>Accept</button></div><div class="post"><h1>{TITLE}</h1>{PARAGRAPHS}</div></body>', TEXT),
    ("sections", f'<body><div id="page"><section><h1>{TITLE}</h1>{PARAGRAPHS}</section><section id="related"><h3>Related</h3><ul><li><a href="/1">Ten harbours</a></li><li><a href="/2">A winter at sea</a></li></ul></section></div></body>', TEXT),
]
