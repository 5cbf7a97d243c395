"""Pages written by hand, in the manner of many sites: (html, the blocks of the article in order)."""

_P = "The river rose in the night and by morning the lower road was gone."
_Q = "Nobody in the village had seen anything like it since the mill burned down."
_R = "Repairs will take until the summer, the council said on Monday."

PAGES = [
    ("<article><p>First words of the article are here.</p><figure><img src=a.png><figcaption>The bridge in 1920.</figcaption></figure></article>", ["First words of the article are here.", "The bridge in 1920."]),
    (f"<article><header><h1>High water</h1></header><p>{_P} <math><mi>x</mi></math></p></article><section id='disqus'><p>I do not believe a word of it.</p></section>", ["High water", f"{_P} x"]),
    (f"<html><body>{_P} {_Q}</body></html>", [f"{_P} {_Q}"]),
    (f"<body><div><p>{_P}</p><p>{_Q}</p></div><div>Copyright 2020 Example Inc. All rights reserved.</div></body>", [_P, _Q]),
    (f"<table><tr><td><a href=/>Home</a><br><a href=/n>News</a><br><a href=/c>Contact</a></td><td><p>{_P}</p><p>{_Q}</p></td></tr></table>", [_P, _Q]),
    (f"<body><h2>High water</h2><p>{_P}</p><p>{_R}</p></body>", ["High water", _P, _R]),
    (f"<html><head><title>High water - The Post</title></head><body><nav><a href=/>Home</a> <a href=/s>Sport</a></nav><main><h1>High water</h1><p>{_P}</p><p>{_Q}</p></main><footer>Privacy policy</footer></body></html>", ["High water", _P, _Q]),
    (f"<body><div id=header><h1>The Post</h1></div><div id=menu><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></div><div id=content><h2>High water</h2><p>{_P}</p></div><div id=footer>All rights reserved.</div></body>", ["High water", _P]),
    (f"<body><div class=cookie-notice><p>We use cookies to improve your experience.</p><button>OK</button></div><article><p>{_P}</p><p>{_Q}</p></article></body>", [_P, _Q]),
    (f"<body><article><p>{_P}</p><div class=ad>Advertisement</div><p>{_Q}</p></article></body>", [_P, _Q]),
    (f"<body><article><p>{_P}</p><aside><h3>Related articles</h3><ul><li><a href=/1>Storm</a></li><li><a href=/2>Flood</a></li></ul></aside><p>{_Q}</p></article></body>", [_P, _Q]),
    (f"<body><div class=post><h1>High water</h1><p>{_P}</p><blockquote>{_Q}</blockquote></div><div class=comments><h3>2 comments</h3><div class=comment><p>Great article, thanks!</p></div></div></body>", ["High water", _P, _Q]),
    (f"<body><div class=entry><p>{_P}</p><ul><li>Take the upper road.</li><li>Boil the water.</li></ul></div></body>", [_P, "Take the upper road.", "Boil the water."]),
    (f"<body><form><label>Search</label><input><button>Go</button></form><article><h1>High water</h1><p>{_P}</p></article></body>", ["High water", _P]),
    (f"<body><article><h1>High water</h1><p>{_P}</p><h2>What now</h2><p>{_R}</p></article><aside class=sidebar><h3>Most read</h3><p>Storm over the hills</p></aside></body>", ["High water", _P, "What now", _R]),
    (f"<body><p>{_P}<p>{_Q}<p>{_R}</body>", [_P, _Q, _R]),
    (f"<body><main><article class=story><p>{_P}</p></article></main><footer><p>&copy; 2021 The Post</p><p>Terms of use</p></footer></body>", [_P]),
    (f"<body><header><div class=logo>The Daily Post</div></header><section class=article><h1>High water</h1><p>{_P}</p><p>{_Q}</p></section></body>", ["High water", _P, _Q]),
    (f"<body><div class=breadcrumb><a href=/>Home</a> <a href=/l>Local</a></div><article><h1>High water</h1><p>{_P}</p></article></body>", ["High water", _P]),
    (f"<body><article><h1>High water</h1><table><tr><td>Monday</td><td>3.1 m</td></tr></table><p>{_P}</p></article></body>", ["High water", "Monday", "3.1 m", _P]),
    (f"<body><div><div><a href=/>Home</a> | <a href=/n>News</a> | <a href=/k>Contact</a></div><div><h1>High water</h1><p>{_P}</p><p>{_Q}</p></div></div></body>", ["High water", _P, _Q]),
    (f"<body><article><p>{_P}</p><p>{_Q}</p></article><div id=respond><h3>Leave a reply</h3><form><textarea></textarea><button>Send</button></form></div></body>", [_P, _Q]),
    (f"<body><article><p>{_P}</p><object data=map><p>A map of the valley.</p></object></article></body>", [_P, "A map of the valley."]),
    (f"<body><article><p>{_P}</p><script>var a = '<p>no</p>';</script><style>p {{ margin: 0 }}</style><p>{_Q}</p></article></body>", [_P, _Q]),
    (f"<body><article><pre>{_P}</pre><dl><dt>Level</dt><dd>{_Q}</dd></dl></article></body>", [_P, "Level", _Q]),
    (f"<body><nav class=menu><ul><li><a href=/>Start</a></li><li><a href=/k>Kontakt</a></li></ul></nav><article><h1>Hochwasser</h1><p>Der Fluss stieg in der Nacht, und am Morgen war die untere Straße fort.</p></article><footer>Impressum</footer></body>", ["Hochwasser", "Der Fluss stieg in der Nacht, und am Morgen war die untere Straße fort."]),
    (f"<body><article><h1>A &amp; B</h1><p>{_P}&nbsp;Yes.</p></article></body>", ["A & B", f"{_P} Yes."]),
    (f"<body><div class=story-body><p>{_P}</p><div class=promo>Try it free for 30 days.</div><p>{_R}</p></div></body>", [_P, _R]),
    (f"<table><tr><td colspan=2><h1>My Blog</h1></td></tr><tr><td><h2>High water</h2><p>{_P}</p><p>{_Q}</p></td><td><a href=/1>Archive</a><br><a href=/2>About</a></td></tr><tr><td colspan=2>Copyright (c) 2015 by the authors.</td></tr></table>", ["High water", _P, _Q]),
    (f"<body><div>{_P}<br><br>{_Q}</div></body>", [f"{_P} {_Q}"]),
    (f"<body><article><p>{_P}</p></article><section class=newsletter><p>Subscribe to our newsletter</p><form><input><button>Sign up</button></form></section></body>", [_P]),
    (f"<body><article role=main><h1>High water</h1><p>{_P}</p><h3>By the numbers</h3><ol><li>One bridge lost.</li><li>Two roads closed.</li></ol></article></body>", ["High water", _P, "By the numbers", "One bridge lost.", "Two roads closed."]),
    (f"<body><div class=topmenu><a href=/>Home</a></div><div class=main><p>{_P}</p><p>Yes.</p><p>{_Q}</p></div></body>", [_P, "Yes.", _Q]),
    (f"<body><div class=modal><p>You have 3 free articles left this month.</p></div><main><p>{_P}</p><p>{_Q}</p><p>{_R}</p></main></body>", [_P, _Q, _R]),
    (f"<body><article><p>{_P}</p><p>All rights reserved.</p><p>{_Q}</p></article><footer>All rights reserved.</footer></body>", [_P, "All rights reserved.", _Q]),
    (f"<body><article><h1>High water</h1><p>{_P}</p><div class=share>Share this</div></article><ul class=comments><li><p>First!</p></li><li><p>Thanks for sharing, very helpful.</p></li></ul></body>", ["High water", _P]),
    (f"<body><header><nav><a href=/>Home</a></nav></header><div class=text><p>{_Q}</p><p>{_R}</p></div><footer><a href=/p>Privacy</a> <a href=/t>Terms</a></footer></body>", [_Q, _R]),
    (f"<html><head><title>T</title></head><body><h1>High water</h1>{_P}<p>{_Q}</p></body></html>", ["High water", _P, _Q]),
    (f"<body><section class=post><header><h2>High water</h2></header><p>{_P}</p></section><section class=widget><h3>Tags</h3><p><a href=/r>river</a></p></section></body>", ["High water", _P]),
    (f"<body><article><p>{_P}</p><blockquote><p>{_Q}</p></blockquote><p>{_R}</p></article><div class=pagination><a href=/1>Previous</a> <a href=/3>Next</a></div></body>", [_P, _Q, _R]),
    (f"<body><div class=banner>Breaking: follow our live coverage.</div><article><p>{_P}</p></article></body>", [_P]),
    (f"<body><div><h1>High water</h1></div><div><p>{_P}</p><p>{_Q}</p></div><div>Powered by WordPress</div></body>", ["High water", _P, _Q]),
    (f"<body><article><p>{_P}</p><div class=signup><p>Sign up for updates</p><input></div><p>{_Q}</p></article></body>", [_P, _Q]),
    (f"<body><main><h1>Inondation</h1><p>Le fleuve est monté dans la nuit et la route du bas a disparu.</p></main><footer>© 2021 Tous droits réservés</footer></body>", ["Inondation", "Le fleuve est monté dans la nuit et la route du bas a disparu."]),
    (f"<body><div class=sidebar><h3>Archives</h3><ul><li><a href=/m>May</a></li><li><a href=/j>June</a></li></ul></div><div class=content><h1>High water</h1><p>{_P}</p><p>{_R}</p></div></body>", ["High water", _P, _R]),
    (f"<article>{_P} {_R}</article>", [f"{_P} {_R}"]),
    (f"<div class=body><h1>High water</h1><p><b>{_P}<br><p>{_Q}</p></div>", ["High water", _P, _Q]),
    (f"<body><article><h1>High water</h1><p>{_P} <a href=/map>See the map</a> for the upper road.</p></article></body>", ["High water", f"{_P} See the map for the upper road."]),
    (f"<body><div role=navigation><a href=/>Home</a></div><div role=main><p>{_P}</p><p>{_Q}</p></div><div role=contentinfo>Contact us | Privacy | Terms</div></body>", [_P, _Q]),
    (f"<body><article><figure><img src=a><figcaption><p>The mill before the fire.</p></figcaption></figure><p>{_Q}</p></article></body>", ["The mill before the fire.", _Q]),
    (f"<body><article><p>{_P}</p><p>{_Q}</p></article><section class=discussion><article><p>My cellar is full of water.</p></article><article><p>Ours too, and nobody came.</p></article></section></body>", [_P, _Q]),
    (f"<body><table><tr><td><h1>High water</h1><p>{_P}</p></td></tr></table></body>", ["High water", _P]),
    (f"<body><h1>High water</h1><p>{_P}</p><p>{_Q}</p><p>{_R}</p><footer>Copyright 2020 Example Inc. All rights reserved.</footer></body>", ["High water", _P, _Q, _R]),
    (f"<body><div class=popup><p>Accept all cookies</p><button>Yes</button></div><div class=page><h2>High water</h2><p>{_P}</p></div></body>", ["High water", _P]),
    (f"<body><nav><ul><li><a href=/>Home</a></li></ul></nav><p>{_P}</p><p>{_Q}</p></body>", [_P, _Q]),
    (f"<body><article><h1>High water</h1><h2>A village waits</h2><p>{_P}</p></article><aside><p>Follow us on Twitter</p></aside></body>", ["High water", "A village waits", _P]),
    (f"<body><div class=hentry><p>{_P}</p><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3.1</td></tr></table></div></body>", [_P, "Day", "Level", "Monday", "3.1"]),
    (f"<body><article><p>{_P}</p></article><div class=related><h3>You may also like</h3><ul><li><a href=/1>The long drought</a></li></ul></div><div class=copyright>&copy; The Post</div></body>", [_P]),
    (f"<body><main><p>{_P}</p><pre>level = 3.1</pre><p>{_R}</p></main></body>", [_P, "level = 3.1", _R]),
    (f"<body><div><p>{_P}</p></div><div><p>{_Q}</p></div><div><a href=/>Home</a> <a href=/s>Sitemap</a> <a href=/h>Help</a></div></body>", [_P, _Q]),
]
