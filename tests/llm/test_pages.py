"""Hand-labelled pages without an article element, and wrappers whose signs are wrong."""

import pytest

from quarry.llm import html_text

A = "The harvest began in the last week of August, when the dew had dried and the ears hung low over the stubble of the lower fields."
B = "By the end of September every barn along the river was full, and the mill at the crossing ran through the night to keep up."
C = "Nobody in the valley could remember a year like it, though the old parish book speaks of one such autumn a century before."
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul>'
COPY = "<p>© 2020 The Valley Press. All rights reserved.</p>"
LINKS = "".join(f'<li><a href="/{i}">Another story from the valley number {i}</a></li>' for i in range(6))

PAGES = {
    "lists and tables": (
        f"<body><div>{NAV}</div><div><h1>Crops</h1><p>{A}</p><ul><li>Wheat, early</li><li>Rye</li><li>Oats and peas</li><li>Barley</li></ul><p>{B}</p>"
        f"<table><tr><th>Year</th><th>Tons</th></tr><tr><td>1901</td><td>12</td></tr></table><h2>Notes</h2><p>Short line.</p><pre>x = 1</pre></div>{COPY}</body>",
        ["Crops", A, "Wheat, early", "Rye", "Oats and peas", "Barley", B, "Year", "Tons", "1901", "12", "Notes", "Short line.", "x = 1"],
    ),
    "text in the body": (f"<body>{NAV}<h1>Harvest</h1><p>{A}</p><p>{B}</p><p>{C}</p>{COPY}</body>", ["Harvest", A, B, C]),
    "form round the page": (
        f"<body><form action='x.aspx'><input type=hidden><div class=nav>{NAV}</div><div><h1>Harvest</h1><p>{A}</p><p>{B}</p></div><div class=footer>{COPY}</div></form></body>",
        ["Harvest", A, B],
    ),
    "role main in a widget": (f'<body><nav>{NAV}</nav><div role="main" class="widget"><h1>Harvest</h1><p>{A}</p><p>{B}</p></div></body>', ["Harvest", A, B]),
    "wrapper in a wrapper": (f"<body><form><div class=dialog><p>{A}</p><p>{B}</p></div></form></body>", [A, B]),
    "cookie notice": (f"<body><div><p>We use cookies to make this site work. By staying you accept them.</p></div><div><p>{A}</p><p>{B}</p></div></body>", [A, B]),
    "related links": (f"<body><div><h1>Harvest</h1><p>{A}</p><p>{B}</p></div><div><h3>More</h3><ul>{LINKS}</ul></div></body>", ["Harvest", A, B]),
    "sidebar by name": (f"<body><div id=content><h1>Harvest</h1><p>{A}</p><p>{C}</p></div><div id=sidebar><h3>About</h3><p>{B}</p></div></body>", ["Harvest", A, C]),
    "comments": (f"<body><div><h1>Harvest</h1><p>{A}</p></div><div class=comments><p>{B}</p><p>{C}</p></div></body>", ["Harvest", A]),
    "login form": (f"<body><form><p>Sign in to comment</p><label>Name</label><input></form><div><h1>Harvest</h1><p>{A}</p><p>{B}</p></div></body>", ["Harvest", A, B]),
    "quote and definition": (f"<body><div><p>{A}</p><blockquote>So it was.</blockquote><dl><dt>Ear</dt><dd>The head of a stalk</dd></dl><p>{B}</p></div></body>", [A, "So it was.", "Ear", "The head of a stalk", B]),
    "nested divs": (f"<body><div><div>{NAV}</div><div><div><h2>One</h2><div>{A}</div></div><div><h2>Two</h2><div>{B}</div></div></div></div></body>", ["One", A, "Two", B]),
    "only links": (f"<body>{NAV}<ul>{LINKS}</ul></body>", []),
    "only a notice": ("<body><div class=cookie-notice><p>We use cookies and similar techniques to remember what you like, and to count visits. You can say no to all of them at any time here.</p></div></body>", []),
    "only comments": (f"<body><div class=comments><p>{A}</p><p>{B}</p></div></body>", []),
    "newsletter box": (f"<body><div><h1>Harvest</h1><p>{A}</p><p>{B}</p></div><div><p>Subscribe to our newsletter for more.</p></div></body>", ["Harvest", A, B]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_without_an_article(name):
    page, want = PAGES[name]
    assert html_text.main_text(page).split("\n\n") == (want or [""])


@pytest.mark.parametrize("attribute", ["class=feedback", "class=legal", "class=search", "class=tags", "class=privacy", "class=dialog", "class=alert-content", "id=notice", "class=widget"])
def test_a_name_alone_does_not_decide(attribute):
    assert html_text.main_text(f"<body><nav>{NAV}</nav><div {attribute}><p>{A}</p><p>{B}</p></div></body>") == f"{A}\n\n{B}"


def test_wrappers_stay_boilerplate_beside_a_text():
    page = f"<body><main><p>{A}</p></main><div class=legal><p>{B}</p><p>{C}</p></div><form><p>{C}</p></form></body>"
    assert html_text.main_text(page) == A
