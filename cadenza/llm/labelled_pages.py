"""The small labelled table that the block classifier of op5 is trained on: hand-written pages, one line a chunk of markup.

A line is `+`, `-` or `=`, a space and markup. The text blocks of a `+` chunk are main text, those of a `-` chunk are not, and `=`
holds markup without text. `{n}` stands for n filler words. An empty line ends a page.
"""

PAGES = """
= <html><body>
- <nav><ul><li><a href="/a">{1}</a></li><li><a href="/b">{2}</a></li><li><a href="/c">{1}</a></li></ul></nav>
- <div class="ad">{9}</div>
= <article>
+ <h1>{6}</h1><p>{3}</p><p>{40}</p><p>{1}</p><p>{25} <a href="/x">{3}</a> {12}</p><p>{90}</p>
= </article>
- <footer>&copy; {8}</footer>

= <html><body>
- <header><a href="/">{2}</a><ul><li><a href="/1">{1}</a></li><li><a href="/2">{1}</a></li></ul></header>
- <div class="banner promo">{14}</div>
= <main>
+ <h1>{4}</h1><p>{22}</p><p>{2}</p><h2>{3}</h2><p>{60}</p><ul><li>{5}</li><li>{12}</li></ul><blockquote>{18}</blockquote>
- <div class="ad">{20}</div>
+ <p>{33}</p><p>{5}</p>
- <section id="comments"><h3>{2}</h3><div class="comment"><p>{30}</p></div><div class="comment"><p>{4}</p></div></section>
= </main>
- <aside><h3>{2}</h3><p>{25}</p><ul><li><a href="/r">{6}</a></li></ul></aside>
- <footer><p>{12}</p><a href="/t">{2}</a></footer>

= <html><body>
- <div id="menu"><a href="/a">{1}</a> <a href="/b">{1}</a> <a href="/c">{2}</a></div>
- <div class="cookie-notice"><p>{28}</p><a href="#">{1}</a></div>
= <div class="content">
+ <h2>{7}</h2><p>{45}</p><p>{70}</p><p>{3}</p>
- <form action="/s"><p>{6}</p><label>{2}</label></form>
+ <p>{15} <a href="/q">{4}</a> {20}</p><pre>{11}</pre>
= </div>
- <div class="sidebar"><p>{35}</p><p><a href="/z">{5}</a></p></div>
- <div class="footer">{16}</div>

= <html><body>
- <p><a href="/a">{2}</a> | <a href="/b">{2}</a> | <a href="/c">{1}</a></p>
+ <h1>{5}</h1><p>{50}</p><p>{65}</p><p>{30}</p><p>{80}</p>
- <p><a href="/n">{5}</a></p><p><a href="/m">{4}</a></p>
- <p>&copy; {3}</p>

= <html><body><table><tr><td>
- <a href="/a">{1}</a><br><a href="/b">{2}</a><br><a href="/c">{2}</a>
= </td><td>
+ <p>{38}</p><p>{55}</p><p>{44}</p>
= </td></tr></table>
- <div>{4} <a href="/p">{2}</a></div>

= <html><body>
- <div role="navigation"><ul><li><a href="/a">{1}</a></li><li>{1}</li></ul></div>
= <article>
- <nav><a href="/1">{2}</a></nav>
= <header>
+ <h1>{8}</h1><p>{6}</p>
= </header>
+ <p>{100}</p><p>{1}</p><h3>{2}</h3><p>{14}</p><p><a href="/only">{3}</a></p><p>{9}</p>
- <aside class="related"><p>{22}</p><a href="/r1">{6}</a></aside>
+ <p>{24}</p>
- <footer><p>{10}</p></footer>
= </article>
- <div class="newsletter"><h3>{4}</h3><p>{24}</p></div>
- <div id="respond"><p>{40}</p></div><div id="disqus_thread"><p>{18}</p></div>

= <html><body>
- <div class="notice">{17}</div><div class="advert"><p>{30}</p></div>
= <article>
+ <p>{2}</p>
= </article>
- <ul class="menu"><li>{2}</li><li>{2}</li></ul>
- <footer>{22}</footer>

= <html><body>
- <div>{2}</div><div><a href="/l">{1}</a></div>
+ <div>{48}</div><div>{75}</div><div>{26} <a href="/i">{2}</a> {31}</div>
- <div><a href="/x">{3}</a> <a href="/y">{3}</a></div><div>{5}</div>

= <html><body>
= <div id="main-content">
+ <h1>{3}</h1><p>{12}</p><p>{4}</p><ol><li>{7}</li><li>{2}</li></ol><p>{28}</p>
- <div class="share">{4}</div><div class="tags"><a href="/g">{1}</a></div>
= </div>
- <div class="login-form"><p>{8}</p></div><div class="widget"><p>{20}</p></div>
- <aside>{30}</aside>

= <html><body>
- <nav><a href="/a">{2}</a></nav>
= <article>
+ <h1>{4}</h1><p>{1}</p><p>{60}</p>

= <html><body>
= <article>
+ <p>{3}</p>

= <html><body>
- <div class="ad">{6}</div>
= <main>
+ <p><a href="/w">{4}</a></p><p>{2}</p><p><a href="/w">{1}</a> {1}</p><p>{8} <a href="/w">{6}</a></p><p>{1}</p>

= <html><body>
+ <p>{35}</p><p>{52}</p>

= <html><body>
+ <p>{24}</p>

= <html><body>
- <p>{1}</p><p><a href="/">{2}</a></p>
= <article>
+ <h1>{2}</h1><p>{4} <a href="/x">{5}</a></p><ul><li><a href="/k">{2}</a></li><li><a href="/k">{3}</a></li></ul><p>{1}</p>
= </article>
- <p>{2}</p><p>{3}</p>

= <html><body>
- <h2>{3}</h2><ul><li><a href="/a">{3}</a></li><li><a href="/b">{4}</a></li></ul><p>{7}</p><p><a href="/">{1}</a> {3}</p>

= <html><body>
- <aside class="sidebar">{60}</aside><div class="comments"><p>{80}</p><p>{2}</p></div><form>{30}</form>
= <article>
+ <h1>{9}</h1><p>{120}</p><p>{1}</p>
- <div class="comments"><p>{45}</p><p>{3}</p></div>

= <html><body>
- <ul><li><a href="/a">{1}</a></li><li><a href="/b">{1}</a></li><li><a href="/c">{2}</a></li><li><a href="/d">{1}</a></li></ul>
- <div class="ad">{10}</div>
= <article>
+ <h1>{7}</h1><p>{30}</p><p>{3}</p><p>{50}</p><p>{2}</p><p>{8}</p><p>{60}</p><p>{1}</p><p>{15}</p>
= </article>
- <footer>&copy; {2} &middot; {8}</footer>

= <html><body>
- <ul><li><a href="/a">{1}</a></li><li><a href="/b">{2}</a></li><li><a href="/c">{1}</a></li></ul>
= <div>
+ <h1>{5}</h1><p>{4}</p><p>{28}</p><h2>{3}</h2><p>{35}</p><p>{6}</p><ul><li>{6}</li><li>{4}</li></ul><p>{40}</p><blockquote>{9}</blockquote><p>{3}</p>
= </div>
- <p>&copy; {4}</p><ul><li><a href="/x">{1}</a></li><li><a href="/y">{2}</a></li></ul>

= <html><body>
- <div><a href="/">{2}</a></div><div><a href="/a">{1}</a> <a href="/b">{1}</a> <a href="/c">{1}</a></div><p>{4} <a href="/l">{3}</a></p>
= <div>
+ <h1>{6}</h1><p>{33}</p><p>{21} <a href="/i">{2}</a> {14}</p><p>{5}</p><p>{18}</p><p>{2}</p><p>{11} <a href="/j">{3}</a></p><p>{44}</p>
= </div>
- <h3>{2}</h3><ul><li><a href="/r">{6}</a></li><li><a href="/s">{7}</a></li><li><a href="/t">{5}</a></li></ul><div>&copy; {5}</div>

= <html><body>
- <header><div>{3}</div></header><nav><a href="/a">{1}</a><a href="/b">{1}</a></nav><div class="notice"><p>{15}</p></div>
= <main>
+ <h1>{5}</h1><p>{2}</p><p>{1}</p><p>{6}</p><p>{13}</p><p>{4}</p>
= </main>
- <div class="sidebar"><h4>{2}</h4><ul><li><a href="/u">{4}</a></li><li><a href="/v">{5}</a></li></ul><p>{18}</p></div>
- <div id="comments"><h3>{2}</h3><p>{22}</p><p>{9}</p></div><form><p>{3}</p></form><footer><p>&copy; {6}</p></footer>

= <html><body>
- <ul><li><a href="/a">{2}</a></li><li><a href="/b">{1}</a></li></ul>
+ <h1>{8}</h1><p>{70}</p><p>{90}</p><p>{12}</p><p>{55}</p>
- <ul><li><a href="/c">{8}</a></li><li><a href="/d">{9}</a></li></ul><p><a href="/e">{2}</a> <a href="/f">{3}</a></p>

= <html><body>
- <nav><ul><li><a href="/a">{1}</a></li><li><a href="/b">{1}</a></li><li><a href="/c">{1}</a></li><li><a href="/d">{1}</a></li><li><a href="/e">{1}</a></li><li><a href="/f">{2}</a></li></ul></nav>
- <div class="ad">{7}</div>
= <article>
+ <h1>{8}</h1><p>{8}</p><p>{9}</p>
= </article>
- <footer>&copy; {1} &middot; {6}</footer>

= <html><body>
- <nav><ul><li><a href="/a">{1}</a></li><li><a href="/b">{1}</a></li><li><a href="/c">{1}</a></li><li><a href="/d">{1}</a></li><li><a href="/e">{1}</a></li><li><a href="/f">{1}</a></li></ul></nav>
- <div class="ad">{9}</div>
= <article>
+ <h1>{5}</h1><p>{2}</p>
= </article>
- <aside><ul><li><a href="/x">{3}</a></li><li><a href="/y">{1}</a></li><li><a href="/z">{2}</a></li></ul></aside><footer><p>{4}</p><ul><li><a href="/g">{1}</a></li><li><a href="/h">{1}</a></li><li><a href="/i">{1}</a></li></ul></footer>
"""
