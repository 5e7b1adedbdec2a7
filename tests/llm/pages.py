"""Pages written by hand, with the text that is to come out; none comes from the training generator."""

FIRST, SECOND, THIRD = "The river rose two metres in the night, and the lower town was cut off.", "Nobody was hurt, said the mayor on Tuesday morning.", "Repairs to the bridge will take until spring, at the least."
BODY, TEXT = f"<p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p>", f"{FIRST}\n{SECOND}\n{THIRD}"
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = '<footer><p>&copy; 2020 The Valley Post. All rights reserved.</p><a href="/imprint">Imprint</a></footer>'

PAGES = {
    "plain article": (f"<html><head><title>t</title></head><body>{MENU}<article><h1>Flood</h1>{BODY}</article>{FOOT}</body></html>", f"Flood\n{TEXT}"),
    "main element": (f"<body>{MENU}<main><h1>Flood</h1>{BODY}</main><aside><h3>Popular</h3><ul><li><a href=1>Cats</a><li><a href=2>Dogs</a></ul></aside>{FOOT}", f"Flood\n{TEXT}"),
    "head without its end tag": (f"<html><head><title>t</title><meta charset=utf-8><body>{MENU}<article>{BODY}</article></body>", TEXT),
    "apostrophes in unquoted values": (f"<body><article><p title=it's>{FIRST}</p><p>{SECOND}</p><p title=it's>{THIRD}</p></article>", TEXT),
    "unclosed button": (f"<body>{MENU}<button>Menu<article>{BODY}</article>{FOOT}", TEXT),
    "unclosed select": (f"<body><select><option>en<option>de<article>{BODY}</article>", TEXT),
    "unclosed object": (f"<body><object data=x.swf><div class=content>{BODY}</div>", TEXT),
    "unclosed title": (f"<title>t<body><article>{BODY}</article>", TEXT),
    "math and fallback text": (f"<body><article><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, see <object>the figure</object>.</p>{BODY}</article>", f"Here x=2 holds, see the figure.\n{TEXT}"),
    "a rule ends a block": (f"<body><article><div>{FIRST}<hr>{SECOND}</div><p>{THIRD}</p></article>", TEXT),
    "text after the end": (f"<html><body><p>{FIRST}</p></body></html><p>{SECOND}</p>", f"{FIRST}\n{SECOND}"),
    "only inline tags": (f"<b>{FIRST}</b> {SECOND}<br>{THIRD}", f"{FIRST} {SECOND} {THIRD}"),
    "no tag at all": (FIRST, FIRST),
    "comments of readers": (f'<body><div id="content">{BODY}</div><div id="comments"><h2>Comments</h2><div class="comment"><p>Sad news, so it is.</p></div><div class="comment"><p>Agreed.</p></div></div>{FOOT}', TEXT),
    "cookie notice and advert": (f'<body><div class="cookie-notice"><p>We use cookies to make this site work, as you know.</p></div>{MENU}<article>{BODY.replace("</p><p>", "</p><div class=advert>Buy two, get one.</div><p>", 1)}</article>', TEXT),
    "form within the article": (f'<body><article><p>{FIRST}</p><form action=/s><label>Mail</label><input name=m><p>Get our letter every week.</p></form><p>{SECOND}</p><p>{THIRD}</p></article>', TEXT),
    "script and style in it": (f"<body><article><p>{FIRST}</p><script>if (a < b) document.write('<p>no</p>')</script><style>p{{}}</style><p>{SECOND}</p><p>{THIRD}</p></article>", TEXT),
    "references": ("<body><article><p>Fish &amp; chips &lt;hot&gt; &#8212; 5&nbsp;&euro; each, at the port.</p><p>Open   \n\t daily, but on Mondays.</p></article>", "Fish & chips <hot> — 5 € each, at the port.\nOpen daily, but on Mondays."),
    "lists and a table": (f"<body>{MENU}<article><p>{FIRST}</p><ul><li>One boat, red</li><li>Two boats, blue</li></ul><table><tr><td>Depth<td>2 m</table><p>{THIRD}</p></article>", f"{FIRST}\nOne boat, red\nTwo boats, blue\nDepth\n2 m\n{THIRD}"),
    "hidden block": (f'<body><article><p>{FIRST}</p><div style="display: none"><p>Not to be seen, ever.</p></div><p>{SECOND}</p></article>', f"{FIRST}\n{SECOND}"),
    "comment tags": (f"<body><!-- <article><p>old</p></article> --><article>{BODY}<!--> <p>{FIRST}</p></article>", f"{TEXT}\n{FIRST}"),
    "unclosed paragraphs": (f"<body><article><p>{FIRST}<p>{SECOND}<p>{THIRD}</article>{FOOT}", TEXT),
    "wrapped deeply": (f'<body><div class=page><div class=wrap><div class=header><a href="/">The Valley Post</a></div><div class=row><div class="post entry"><h1>Flood</h1>{BODY}</div><div class=sidebar><p><a href=1>More</a></p></div></div></div></div>{FOOT}', f"Flood\n{TEXT}"),
    "comment marks in a script": (f'<body><script>var s="<!--";</script>{MENU}<article>{BODY}</article>{FOOT}', TEXT),
    "comment marks in a style": (f"<head><style>p:before {{content: '<!--'}}</style></head><body>{MENU}<article>{BODY}</article>{FOOT}", TEXT),
    "comment marks in a title": (f"<head><title>How to use <!-- in HTML</title></head><body>{MENU}<article>{BODY}</article>{FOOT}", TEXT),
    "tags in a script": (f"<body><script>document.write('<div title=\"</scr' + '<nav>')</script>{MENU}<article>{BODY}</article>", TEXT),
    "layout table": (f"<body><table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><h1>Flood</h1>{BODY}</td></tr></table>{FOOT}", f"Flood\n{TEXT}"),
    "truncated": (f"<body>{MENU}<article><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p><a hre", TEXT),
}
