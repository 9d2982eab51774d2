"""Pages written by hand, with the main text that a reader would name; the model's composer made none of them."""

PAGES = [
    (
        """<!doctype html><html lang=en><head><title>Bridge reopens - The Harbour Post</title><link rel=stylesheet href=a.css><style>.x{color:red}</style></head><body>
<a class="skip-link" href="#c">Skip to content</a>
<header role="banner"><div class="logo"><a href="/">The Harbour Post</a></div><nav class="primary-nav"><ul><li><a href="/n">News</a><li><a href="/s">Sport</a><li><a href="/w">Weather</a></ul></nav></header>
<div class="advertisement"><p>Save on car insurance today. Call now!</p></div>
<main id="c"><article class="story"><h1>Bridge reopens after two years</h1>
<p>The old swing bridge over the river opened to traffic on Monday, two years after a barge damaged its northern pier.</p>
<p>Engineers replaced more than four hundred rivets &mdash; each of them by hand &mdash; and repainted the steel. &ldquo;It looks as it did in 1911,&rdquo; said the chief engineer.</p>
<figure><img src=b.jpg alt=""><figcaption>The bridge on Monday morning.</figcaption></figure>
<p>Ferries that ran in its place will stop at the end of the week.</p></article></main>
<aside class="sidebar"><h2>Most read</h2><ol><li><a href=1>Council to vote on parking</a><li><a href=2>Rain expected all week</a></ol></aside>
<section id="comments" class="comments"><h2>Comments (2)</h2><div class="comment"><b>anna</b><p>About time. I was late for work every day for two years because of this.</p></div><div class="comment"><b>tom</b><p>The ferry was nicer, I will miss it.</p></div></section>
<footer><p>Copyright 2021 The Harbour Post. All rights reserved.</p><a href=/p>Privacy</a></footer></body></html>""",
        "Bridge reopens after two years The old swing bridge over the river opened to traffic on Monday, two years after a barge damaged its northern pier. Engineers replaced more than four hundred rivets — each of them by hand — and repainted the steel. “It looks as it did in 1911,” said the chief engineer. The bridge on Monday morning. Ferries that ran in its place will stop at the end of the week.",
    ),
    (
        """<html><head><title>sourdough</title></head><body class="blog home"><div id="wrapper"><div id="header"><h1 class="site-title"><a href="/">Crumb and Crust</a></h1><p class="tagline">Baking at home</p></div>
<div id="menu"><a href=/a>Recipes</a> | <a href=/b>About</a> | <a href=/c>Contact</a></div>
<div id="content"><div class="post hentry"><h2 class="entry-title">A slow sourdough loaf</h2>
<div class="entry-content"><p>Mix the flour and the water, and leave them alone for an hour.<p>Then work in the starter and the salt. Fold the dough every half hour, four times in all.
<ul><li>500 g of strong flour</li><li>350 g of water</li><li>100 g of starter</li><li>10 g of salt</li></ul>
<p>Bake it in a hot pot for forty minutes, the last ten <em>without</em> the lid.</div>
<div class="sharedaddy share-buttons"><span>Share this:</span> <a href=t>Twitter</a> <a href=f>Facebook</a></div></div></div>
<div id="secondary" class="widget-area"><div class="widget"><h3>Recent posts</h3><ul><li><a href=r1>Rye crackers</a></li><li><a href=r2>Brioche for beginners</a></li></ul></div><div class="widget"><h3>Newsletter</h3><form action=s><input name=e><button>Subscribe</button></form></div></div>
<div id="colophon">Proudly powered by a blog engine</div></div></body></html>""",
        "A slow sourdough loaf Mix the flour and the water, and leave them alone for an hour. Then work in the starter and the salt. Fold the dough every half hour, four times in all. 500 g of strong flour 350 g of water 100 g of starter 10 g of salt Bake it in a hot pot for forty minutes, the last ten without the lid.",
    ),
    (
        """<HTML><BODY BGCOLOR="#FFFFFF"><H1>The lighthouse keepers</H1>
<P>There were three of them, and they took turns at the lamp from dusk until the morning.
<P>In winter the boat could not land for weeks, and letters came in a tin box thrown from the deck.
<BR>One of the keepers wrote all of it down, and his notebooks are kept in the town library.
<P>The lamp was made electric in 1962. The house has been empty since.</BODY></HTML>""",
        "The lighthouse keepers There were three of them, and they took turns at the lamp from dusk until the morning. In winter the boat could not land for weeks, and letters came in a tin box thrown from the deck. One of the keepers wrote all of it down, and his notebooks are kept in the town library. The lamp was made electric in 1962. The house has been empty since.",
    ),
    (
        """<!DOCTYPE html><html><body><div class="cookie-notice" id="gdpr"><p>This site uses cookies to make it work better. By going on you accept them.</p><button>Accept</button><button>Reject</button></div>
<div class="layout"><div class="col-left toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li><li><a href="#q">Questions</a></li></ul></div>
<div class="col-main markdown-body"><h1>pumpctl</h1><p>A small command for garden pumps.</p><h2 id=i>Install</h2><pre><code>make
make install</code></pre><h2 id=u>Use</h2><p>Start the pump with <code>pumpctl on</code>, and stop it with <code>pumpctl off</code>. The state is kept in a file.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-t</td><td>stop after some minutes</td></tr></table></div></div>
<script src=/track.js/>var loaded = 1;</script><noscript><img src=p.gif>Please enable scripts</noscript><div class="footer-links"><a href=/l>Licence</a> <a href=/s>Source</a></div></body></html>""",
        "pumpctl A small command for garden pumps. Install make make install Use Start the pump with pumpctl on, and stop it with pumpctl off. The state is kept in a file. Option Meaning -t stop after some minutes",
    ),
    (
        """<html><body><table width=100%><tr><td class=top><a href=/>Home</a> <a href=/f>Forum</a> <a href=/l>Links</a></td></tr><tr><td class="content"><b>Finding mushrooms in late autumn</b><br><br>
Look under beeches first. The ground keeps its warmth there, and frost comes late.<br><br>Take a basket, not a bag, and cut the stems with a knife, so that the rest can grow again.<br><br>Never eat what you cannot name for sure.</td></tr><tr><td class=bottom><small>Last changed 1999. Mail the webmaster.</small></td></tr></table></body></html>""",
        "Finding mushrooms in late autumn Look under beeches first. The ground keeps its warmth there, and frost comes late. Take a basket, not a bag, and cut the stems with a knife, so that the rest can grow again. Never eat what you cannot name for sure.",
    ),
    (
        """<!DOCTYPE html><html lang="de"><body><nav aria-label="breadcrumb"><ol class="breadcrumb"><li><a href=/>Start</a></li><li><a href=/r>Reisen</a></li><li>Bergsee</li></ol></nav>
<section class="hero-article"><h1>Ein Tag am Bergsee</h1><div class="byline">Von Maria Huber, 3. Mai</div><div class="article-text"><p>Der Weg beginnt hinter der Kapelle und führt zuerst durch den Wald.</p><p>Nach zwei Stunden öffnet sich das Tal, und der See liegt still zwischen den Felsen.</p>
<div class="ad-slot"><span>Anzeige</span><a href=x>Wanderschuhe jetzt günstig kaufen</a></div><p>Wer baden will, braucht Mut: Das Wasser ist selten wärmer als zwölf Grad.</p></div></section>
<div class="related-articles"><h3>Das könnte Sie auch interessieren</h3><a href=1>Hütten im Überblick</a><a href=2>Die besten Käsereien</a><a href=3>Mit dem Rad ans Meer</a></div><footer class="site-footer">Impressum Datenschutz</footer></body></html>""",
        "Ein Tag am Bergsee Der Weg beginnt hinter der Kapelle und führt zuerst durch den Wald. Nach zwei Stunden öffnet sich das Tal, und der See liegt still zwischen den Felsen. Wer baden will, braucht Mut: Das Wasser ist selten wärmer als zwölf Grad.",
    ),
    ("<p>Just one paragraph without any frame around it, but with a few sentences. This is the second. And here is a third one.</p>", "Just one paragraph without any frame around it, but with a few sentences. This is the second. And here is a third one."),
]
