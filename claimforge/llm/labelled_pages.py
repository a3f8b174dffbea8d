"""Pages labelled by hand, block by block: a block's text begins with + if it is main text, with - if it isn't."""

from __future__ import annotations

#: Sentences that the pages are filled with: of articles, of readers, of advertisers.
TEXTS = {
    "A1": "The river rose during the night, and by morning the lower road was under water. People carried what they could.",
    "A2": "Nobody had expected it so early in the year. The council met at noon; it decided to open the old mill.",
    "A3": "In the second half of the century the harbour lost most of its trade, partly because ships had grown too large for it, and partly because the railway took the grain.",
    "A4": "Heat the oil in a wide pan and add the onions. When they are soft, stir in the flour.",
    "A5": "We measured the samples three times and took the mean, which differed from earlier results by less than one percent.",
    "A6": "She had lived in the house for forty years.",
    "A7": "The new rule applies from March, the ministry said on Tuesday, and covers all firms with more than fifty employees.",
    "A8": "To install the package, unpack the archive and run the script that is in its first folder. No other steps are needed.",
    "A9": "I was born in the house by the mill, and my mother kept the books there until she was eighty.",
    "A10": "You need two pans, a sharp knife and an hour of your time. Is it worth it? It is.",
    "A11": "Der Rat trat mittags zusammen und beschloss, die alte Brücke im Frühjahr zu erneuern.",
    "A12": "La mairie a fermé la route pendant trois semaines, le temps de refaire le pont et ses deux rampes.",
    "R6": "I don't believe a word of it. You should have asked the people who live there.",
    "R7": "Thank you, this helped me a lot with my own roof.",
    "R8": "Wonderful, I read it twice and sent it to my sister.",
    "R9": "Danke für den Text, ich habe viel gelernt!",
    "R10": "Je ne suis pas d'accord, vous oubliez les commerçants.",
    "R11": "The second paragraph is wrong, it was in May.",
    "R12": "Has anyone tried this with cheaper oil? Mine burned.",
    "R13": "This is rubbish.",
    "R14": "Where is the source for that? Nobody has ever seen it.",
    "R15": "My aunt always told us this story, but she left out the end.",
    "R16": "Nice one.",
    "V5": "Subscribe to read on, the first month is free.",
    "V6": "This text is for members. Log in or become one.",
    "R1": "I think this is wrong, the mill was never closed. My father worked there!",
    "R2": "Thanks for writing this. It was a good read.",
    "R3": "Does anyone know whether the bridge is open again? I have to drive there on Monday.",
    "R4": "Totally agree with the author, and with what was said above. We tried it last year and it worked.",
    "R5": "First! Great text, really.",
    "V1": "Buy two pairs of shoes, pay for one. Only today, only in our shop.",
    "V2": "Ten walks near town that you should try this summer, by our readers.",
    "V3": "Save up to forty percent on your next holiday. Book now and travel later.",
    "V4": "Sign up for our letters, every Monday, and never miss a story again.",
}

_PAGES = [
    "<head><title>-Flood</title></head><body><header><h2>-Daily Post</h2><p>-All the news since 1901.</p></header><nav><ul><li><a href=/>-Home</a></li><li><a href=/s>-Sport</a></li></ul></nav><main><h1>+Flood in the valley</h1><p>+A1</p><p>+A2</p><ul><li>+First, the bridge closed.</li><li>+Then the trains stopped.</li></ul></main><aside><h3>-Related</h3><p>-V2</p></aside><footer>-© 2020 Daily Post</footer></body>",
    "<body><div class='cookie-notice'><p>-We use cookies. By staying on this page you accept our policy.</p><button>-Accept</button></div><div class=menu><a href=1>-News</a> <a href=2>Mail</a></div><div class='content'><h1>+Notes</h1><p>+A2</p><blockquote>+A1</blockquote><p>+Short end.</p></div><div id=comments><h3>-Comments</h3><div class=comment><p>-R1</p></div><div class=comment><p>-R2</p></div></div><div class=footer><p>-Imprint and contact. All rights reserved.</p></div></body>",
    "<body><article><header><p>-By A. Writer, 3 min</p></header><h1>+Old mill</h1><p>+A1</p><div class='ad'>-V1</div><p>+A2</p><form><label>-Your mail</label><input><p>-V4</p></form><p>+A3</p><section class=comments><p>-R5</p><p>-R1</p></section></article><footer><p>-Terms. Privacy.</p></footer></body>",
    "<body><div class=sidebar><h4>-Archive</h4><ul><li><a href=1>-May</a></li><li><a href=2>-June</a></li></ul><p>-About this site: we write about rivers, mills and roads.</p></div><div class='post entry'><h2>+Roads</h2><p>+A2</p><p>+A3</p><pre>+a = 1</pre><table><tr><td>+May</td><td>+12 days</td></tr></table></div><div class='related'><p>-V2</p></div><div class='share'>-Share this page</div></body>",
    "<body><article><h1>+Harbour</h1><p>+A3</p><p>+A6</p><section id=responses><h2>-3 responses</h2><p>-R3</p><p>-R4</p><p>-R2</p></section></article><footer>-Contact</footer></body>",
    "<body><article><h1>+Rules</h1><p>+A7</p><section><h2>+What changes</h2><p>+A5</p></section><section><h2>+What stays</h2><p>+A2</p></section><section id=reader-replies><p>-R4</p><p>-R1</p></section></article></body>",
    "<body><article><h1>+Method</h1><section id=introduction><p>+A5</p></section><section id=results class=chapter><h2>+Results</h2><p>+A3</p></section><section class=discussion-thread><h2>-Discussion</h2><div><p>-R1</p></div><div><p>-R3</p></div></section></article></body>",
    "<body><div id=top-bar><a href=1>-Log in</a> <a href=2>Register</a></div><div id=wrapper><div id=article-body><h1>+Onion soup</h1><p>+A4</p><ol><li>+Chop the onions.</li><li>+A4</li></ol></div><div id=user-feedback><p>-R2</p><p>-R4</p></div></div><div id=bottom>-© 2019, all rights reserved</div></body>",
    "<body><nav class=breadcrumb><a href=/>-Home</a> <a href=/b>Books</a></nav><main><article><h1>+A house</h1><p class=lead>+A6</p><p>+A3</p><figure><figcaption>+The house in 1950.</figcaption></figure><p>+A1</p></article><div class=newsletter-box><h3>-Newsletter</h3><p>-V4</p></div><div class=promo><p>-V3</p></div></main><footer><ul><li><a href=1>-Imprint</a></li><li><a href=2>-Privacy</a></li></ul></footer></body>",
    "<body><table><tr><td class=left><a href=1>-Start</a><br><a href=2>Links</a></td><td class=main><h1>+Install</h1><p>+A8</p><pre>+sh first/run.sh</pre><p>+A5</p></td><td class=right><p>-V1</p></td></tr></table></body>",
    "<body><div class=banner-ad>-V3</div><div role=main><h1>+Tuesday</h1><p>+A7</p><p>+A2</p><div class=pullquote><p>+A6</p></div><p>+A1</p></div><div class='ad-slot'><p>-V1</p></div><div class=comment-list><ul><li>-R1</li><li>-R5</li></ul></div></body>",
    "<body><div class=popup><h2>-Subscribe</h2><p>-V4</p><button>-No thanks</button></div><article><h1>+Trade</h1><p>+A3</p><aside><p>-V2</p></aside><p>+A7</p><div class=author-bio><p>-A. Writer lives near the river and writes on trade.</p></div><div class=tags><a href=1>-trade</a> <a href=2>harbour</a></div></article></body>",
    "<body><header><a href=/>-Cookbook</a></header><section class=recipe><h1>+Soup</h1><ul class=ingredients><li>+2 onions</li><li>+1 spoon of flour</li></ul><p>+A4</p></section><section class=reviews><h2>-Reviews</h2><p>-R2</p><p>-R4</p></section><footer>-© Cookbook</footer></body>",
    "<body><div class=sponsored><p>-V3</p></div><div class=story><h1>+Night</h1><p>+A1</p><p>+A6</p><p>+A2</p></div><div class=more-stories><h3>-More stories</h3><ul><li><a href=1>-Ten walks</a></li><li><a href=2>-The old mill</a></li></ul></div><div class=disclaimer><p>-Views are the writers' own. No liability is taken for links.</p></div></body>",
    "<body><article><h1>+Ministry</h1><p>+A7</p><p>+A3</p><div id=talk><h3>-Your opinions</h3><p>-R1</p><p>-R3</p><form><textarea></textarea><button>-Send</button></form></div></article></body>",
    "<body><article><h1>+Sample</h1><p>+A5</p><p>+A8</p><section id=letters><h2>-Readers write</h2><p>-R4</p><p>-R2</p></section><footer>-Filed under science</footer></article></body>",
    "<body><ul class=nav-tabs><li><a href=1>-Article</a></li><li><a href=2>-Talk</a></li></ul><div id=mw-content-text><h1>+Harbour</h1><p>+A3</p><h2>+History</h2><p>+A1</p><p>+A2</p><h2>+Today</h2><p>+A7</p></div><div class=printfooter>-Last changed in May.</div></body>",
    "<body><div class=alert><p>-Your browser is out of date. Some pages may not work.</p></div><article><p>+A1</p><p>+A2</p><p>+A3</p><p>+A6</p></article><div class=pagination><a href=1>-Next</a></div></body>",
    "<body><div>-V1</div><div><h1>+Mill</h1><p>+A2</p><p>+A1</p><p>+A7</p></div><div><a href=1>-Imprint</a></div></body>",
    "<body><nav><a href=1>-Home</a></nav><div><h1>+Oil</h1><p>+A4</p><p>+A4</p><p>+A6</p></div><footer>-© us</footer></body>",
    "<body><nav><ul><li><a href=1>-one</a></li><li><a href=2>-two</a></li></ul></nav><div class=ad>-V1</div><div><h1>+House</h1><p>+A6</p><p>+A3</p><p>+A5</p></div><footer>-© house and more</footer></body>",
    "<body><nav><ul><li><a href=1>-one</a></li></ul></nav><div class=advert>-V2</div><section><h1>+Means</h1><p>+A5</p><p>+A7</p></section><section class=responses-area><p>-R2</p><p>-R3</p></section><footer>-© means</footer></body>",
    "<body><article><h1>+Bridge</h1><p>+A2</p><p>+A1</p><div class=social-share><a href=1>-Tweet</a> <a href=2>Mail</a></div><ol class=commentlist><li>-R1</li><li>-R4</li><li>-R5</li></ol></article></body>",
    "<body><article><h1>+Grain</h1><p>+A3</p><p>+A2</p><section id=respond><h3>-Leave a reply</h3><p>-Your address will not be shown. Fields with a star are needed.</p></section></article></body>",
    "<body><div class=login-form><p>-Please log in to read on.</p></div><main><h1>+Firms</h1><p>+A7</p><dl><dt>+Firm</dt><dd>+Any company with staff.</dd></dl><p>+A3</p></main><div class=toolbar><a href=1>-Print</a></div></body>",
    "<body><article class=post><h1>+Package</h1><p class=intro>+A8</p><div class=body-text><p>+A5</p><p>+A8</p></div><div class=responses><article><p>-R3</p></article><article><p>-R4</p></article></div></article></body>",
    "<body><article><h1>+Water</h1><p>+A1</p><p>+A2</p><div class=note><p>+A6</p></div><p>+A3</p><section class=feedback><h2>-Feedback</h2><p>-R2</p></section><section class=recommended><h2>-You may also like</h2><p>-V2</p></section></article></body>",
    "<body><div class=masthead><h1>-The Post</h1><p>-Morning edition</p></div><div class=article><h2>+Council meets</h2><p>+A2</p><p>+A7</p></div><div class=column-right><h4>-Weather</h4><p>-Rain, then sun.</p><h4>-Most read</h4><p>-V2</p></div></body>",
    "<body><main><h1>+Steps</h1><p>+A8</p><h2>+First step</h2><p>+A4</p><h2>+Second step</h2><p>+A5</p></main><section id=comment-section><h2>-2 comments</h2><p>-R1</p><p>-R2</p></section></body>",
    "<body><div class=privacy-banner>-We and our partners store data on your device.</div><article><h1>+Years</h1><p>+A6</p><p>+A3</p></article><div id=conversation><h2>-Join the conversation</h2><p>-R3</p><p>-R1</p></div><div class=legal>-No part may be copied.</div></body>",
    "<body><article><h1>+Trade again</h1><p>+A3</p><p>+A7</p><section id=responses><p>-R1</p><p>-R4</p></section></article><footer>-© trade</footer></body>",
    "<body><nav><a href=1>-Up</a></nav><article><h1>+Notes on soup</h1><p>+A4</p><section id=notes><p>+A6</p></section><section id=replies><p>-R2</p></section></article><footer>-Down</footer></body>",
    # pages whose elements' names say nothing
    "<body><article><h1>+Dam</h1><p>+A1</p><p>+A3</p><p>+A2</p><div class=x1><p>-R6</p><p>-R7</p></div></article><footer>-© dam</footer></body>",
    "<body><nav><a href=1>-Up</a></nav><article><h1>+Rail</h1><p>+A3</p><p>+A7</p><p>+A6</p></article><div class=b-27><p>-R8</p><p>-R12</p></div><footer>-© rail</footer></body>",
    "<body><article><h1>+Well</h1><p>+A2</p><p>+A5</p><div><p>-R1</p></div><div><p>-R6</p></div></article></body>",
    "<body><article><h1>+Pan</h1><p>+A10</p><p>+A4</p><p>+A8</p></article><div><p>-R7</p><p>-R3</p><p>-R11</p></div><footer>-© pan</footer></body>",
    "<body><div class=q><h1>+Mother</h1><p>+A9</p><p>+A6</p><p>+A9</p></div><div class=r><p>-R2</p><p>-R8</p></div></body>",
    "<body><article><h1>+My house</h1><p>+A9</p><div class=k><p>+A9</p><p>+A6</p></div><p>+A1</p></article><footer>-© house</footer></body>",
    "<body><article><h1>+Parts</h1><section class=k1><p>+A3</p><p>+A1</p></section><section class=k2><p>+A5</p></section><section class=k3><p>+A7</p><p>+A2</p></section></article></body>",
    "<body><article><h1>+Parts again</h1><section><p>+A3</p><p>+A1</p></section><section><p>+A5</p><p>+A6</p></section><section><p>-R12</p><p>-R2</p></section></article></body>",
    "<body><nav><ul><li><a href=1>-one</a></li></ul></nav><article><h1>+Fluss</h1><p>+A11</p><p>+A11</p><ol class=z><li>-R9</li><li>-R6</li></ol></article><footer>-© Fluss</footer></body>",
    "<body><article><h1>+Pont</h1><p>+A12</p><p>+A12</p><section class=w><p>-R10</p><p>-R9</p></section></article><footer>-© pont</footer></body>",
    "<body><article><h1>+Steps</h1><p>+A8</p><ol><li>+A4</li><li>+A10</li></ol></article><div id=t9><div><p>-R7</p></div><div><p>-R12</p></div></div></body>",
    "<body><main><h1>+Grain</h1><p>+A3</p><p>+A2</p><div class=c><p>+A5</p></div></main><footer>-© grain</footer></body>",
    "<body><article><h1>+Lime</h1><p>+A5</p><p>+A7</p><p>+A1</p><ul class=u><li>-R4</li><li>-R5</li><li>-R1</li></ul></article></body>",
    "<body><article><h1>+Ice</h1><p>+A2</p><p>+A6</p><p>+A3</p></article><section class=g><article><p>-R3</p></article><article><p>-R11</p></article><article><p>-R8</p></article></section><footer>-© ice</footer></body>",
    "<body><header><p>-The Valley</p></header><div><div><h1>+Snow</h1><p>+A1</p><p>+A2</p></div><div><p>-R8</p><p>-R10</p></div></div><footer>-© valley</footer></body>",
    "<body><article><h1>+Quote</h1><p>+A7</p><blockquote><p>+A9</p></blockquote><p>+A3</p><div><p>+A12</p></div></article></body>",
    "<body><article><h1>+Sand</h1><p>+A5</p><p>+A3</p><div class=m1><p>-R11</p><p>-R6</p><p>-R2</p></div></article><div class=m2><p>-V3</p></div></body>",
    "<body><article><h1>+Last</h1><p>+A3</p><p>+A2</p><p>+A1</p><p>+A6</p><section><p>-R7</p></section></article><footer>-© last</footer></body>",
    "<body><article><h1>+Ferry</h1><p>+A1</p><p>+A3</p><p>+A7</p><p>-R6</p><p>-R7</p></article><footer>-© ferry</footer></body>",
    "<body><nav><a href=1>-Up</a></nav><article><h1>+Field</h1><p>+A5</p><p>+A2</p><p>+A3</p><p>-R15</p><p>-R12</p><p>-R2</p></article></body>",
    "<body><article><h1>+Lock</h1><p>+A11</p><p>+A7</p><p>+A1</p></article><p>-R9</p><p>-R15</p><footer>-© lock</footer></body>",
    "<body><article><h1>+Tile</h1><p>+A3</p><p>+A2</p><p>+A12</p><p>-R10</p><p>-R1</p></article></body>",
    "<body><article><h1>+Nail</h1><p>+A3</p><p>+A2</p><p>+A7</p><section class=h2x><p>-R13</p><p>-R14</p></section></article></body>",
    "<body><article><h1>+Rope</h1><p>+A1</p><p>+A5</p><p>+A7</p><div><p>-R14</p><p>-R13</p><p>-R16</p></div></article><footer>-© rope</footer></body>",
    "<body><article><h1>+Sail</h1><p>+A1</p><p>+A12</p><p>+A3</p></article><section class=s8><p>-R16</p><p>-R14</p></section><footer>-© sail</footer></body>",
    "<body><article><h1>+Mast</h1><p>+A11</p><p>+A5</p><p>+A3</p></article><ul><li>-R13</li><li>-R15</li></ul><footer>-© mast</footer></body>",
    "<body><article><h1>+Oats</h1><p>+A3</p><p>+A2</p><div class=n4><p>-V5</p></div></article><footer>-© oats</footer></body>",
    "<body><article><h1>+Barn</h1><p>+A1</p><div><p>-V6</p></div><p>+A7</p><p>+A5</p></article><footer>-© barn</footer></body>",
    "<body><article><h1>+Hay</h1><p>+A7</p><p>+A5</p><p>+A3</p><div class=z2><p>-V6</p><button>-Log in</button></div></article></body>",
    "<body><article><h1>+Wheel</h1><p>+A9</p><p>+A10</p><p>+A9</p><p>+A6</p></article><footer>-© wheel</footer></body>",
    "<body><article><h1>+Short</h1><p>+A3</p><p>+A7</p><p>+A6</p><p>+A6</p></article><footer>-© short</footer></body>",
    "<body><article><h1>+Axle</h1><p>+A5</p><p>+A2</p><p>+A9</p><p>+A3</p></article><div class=v7>-V5</div></body>",
    "<body><article><h1>+Bolt</h1><p>+A5</p><p>+A2</p><p>+A3</p><p>+A7</p><div class=o1><p>-Subscribe to go on.</p></div></article><footer>-© bolt</footer></body>",
    "<body><article><h1>+Cart</h1><p>+A3</p><div class=o2><p>-Log in to read the full text.</p></div><p>+A1</p><p>+A11</p></article></body>",
    "<body><nav><a href=1>-Up</a></nav><article><h1>+Yoke</h1><p>+A12</p><p>+A1</p><p>+A2</p><div class=o3><p>-Become a member and read every story.</p></div></article><footer>-© yoke</footer></body>",
    "<body><article><h1>+Reed</h1><p>+A3</p><p>+A1</p><p>+A5</p><section class=o4><p>-R14</p><p>-R11</p></section></article><footer>-© reed</footer></body>",
    "<body><article><h1>+Moss</h1><p>+A7</p><p>+A11</p><p>+A1</p><p>+A3</p><section><p>-R16</p><p>-R15</p></section></article></body>",
]


def filled(page: str) -> str:
    for name, text in TEXTS.items():
        page = page.replace(f"+{name}<", f"+{text}<").replace(f"-{name}<", f"-{text}<")
    return page


PAGES = [filled(p) for p in _PAGES]

#: Pages that no field is trained on: other class names, other places, other words.
HELD_OUT = [
    "<body><div id=kopf><a href=1>-Start</a> <a href=2>Archiv</a></div><div id=haupttext><h1>+Das Hochwasser</h1><p>+In der Nacht stieg der Fluss, und am Morgen stand die untere Straße unter Wasser. Viele trugen fort, was sie konnten.</p><p>+Der Rat trat mittags zusammen. Er beschloss, die alte Mühle zu öffnen.</p></div><div id=fuss>-© 2021 Der Bote</div></body>",
    "<body><article><h1>+Le marché</h1><p>+Le marché ouvre à huit heures, et les premiers clients arrivent peu après. On y vend surtout des légumes.</p><p>+La mairie a promis de refaire la place avant l'été.</p><section id=comments-fr><h2>-Comments</h2><p>-Merci pour cet article, je ne savais pas tout cela.</p><p>-Et le parking ? On n'en parle jamais !</p></section></article><footer>-© Mairie</footer></body>",
    "<body><nav><a href=1>-All</a> <a href=2>News</a></nav><div class=advertising-top>-Get a new phone for one coin a month.</div><div class=text-column><h1>+Bees</h1><p>+The hives stood behind the barn, seven in a row, and nobody had opened them since autumn.</p><p>+In March the first bees came out. They were few.</p></div><div class=community-responses><p>-Lovely piece, thank you so much.</p><p>-We lost all of ours this winter, does anyone know why?</p></div></body>",
    "<body><main><h1>+Glass</h1><p>+Glass is made from sand, soda and lime, which are melted together at great heat.</p><table><tr><td>+Sand</td><td>+70 parts</td></tr></table><p>+It is then blown, drawn or rolled.</p></main><aside class=teaser><h4>-Also on this site</h4><p>-How paper is made, and who made it first.</p></aside><footer><p>-All rights reserved.</p></footer></body>",
    "<body><div class=consent-layer><p>-This site stores data on your device to work better.</p><button>-Fine</button></div><article><h1>+Roof</h1><p>+The roof had been mended twice, and still the rain came in at the north side.</p><p>+They moved the beds.</p><div class=subscribe-inline><p>-Get one mail a week with our best texts.</p></div><p>+By June it was dry again, and nobody spoke of it.</p></article><div class=comments-wrap><p>-Same here, our roof leaks as well!</p></div></body>",
    "<body><article><h1>+Clock</h1><p>+The clock on the tower stopped at ten past four, as it had every winter.</p><p>+A man came from the city to look at it. He stayed three days.</p><section id=responses><p>-My uncle was that man, he told us about it.</p><p>-Nice story.</p></section></article></body>",
]
