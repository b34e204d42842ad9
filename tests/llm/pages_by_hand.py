"""Pages written by hand, unlike those of the test tables: ``+`` marks lines of the main body, ``-`` all others.

The first list has pages with a body, the second pages that are nothing but residue, the third pages that speak of residue or hold some beside content.
"""

BODIES = """\
-Skip to content
-The Valley Courier
-News  Sport  Weather  Opinion  Subscribe
-Home > News > Local
+Council approves new footbridge over the Tarn
+By Helen Marsh, local reporter
+The town council voted 9 to 3 on Tuesday to build a footbridge beside the old weir. Work should begin in April.
+"People have asked for this for twenty years," said councillor Dev Patel after the meeting.
+The bridge will cost 2.4 million pounds, half of which comes from the county.
-Share this article
-Facebook  Twitter  Email
-Related stories
-Weir repairs delayed again
-Bus fares to rise in May
-© 2023 The Valley Courier. All rights reserved.
-Privacy | Cookies | Terms
===
-Menu
-Home
-Blog
-About
-Contact
+Why I stopped using a food processor
+Last winter my food processor finally gave up, and I decided not to replace it. I have not missed it once.
+A sharp knife is quicker for one onion, and it is far easier to clean. For dough I use my hands.
+There is one exception: nut butter. For that I borrow my neighbour's machine.
-Tags: kitchen, tools, minimalism
-Previous post: My favourite soups
-Next post: Sharpening at home
-Leave a Reply
-Your email address will not be published.
-Post Comment
-Powered by WordPress
===
-Docs | Tutorials | Community | Sign in
-Search docs
+Writing your first template
+Templates let you write a page once and fill it with data later.
+Put a variable in double braces where the value should appear:
+```
+<h1>Hello {{ name }}</h1>
+```
+When the page is rendered, the name is replaced by the value you passed in.
-Was this page helpful? Yes No
-© 2024 Example Docs
===
-We use cookies to improve your experience. Accept all  Reject
-Shop  Sale  Basket (2)
-Home / Garden / Tools
+Long-handled hoe, ash
+A light hoe for weeding between rows without bending. The head is forged from one piece of steel.
+- Length: 150 cm
+- Weight: 1.2 kg
+- Handle: ash, oiled
+It should be kept dry and sharpened twice a year.
-Add to basket
-You might also like
-Dutch hoe, small
-Hand fork
-Customer service | Returns | Delivery
===
-Startseite
-Aktuelles
-Verein
-Kontakt
+Sommerfest am 12. Juli
+Der Gartenverein lädt alle Nachbarn zum Sommerfest ein. Ab 15 Uhr gibt es Kaffee und Kuchen auf der Wiese.
+Für Kinder stehen eine Hüpfburg und ein Basteltisch bereit. Bei Regen feiern wir im Vereinsheim.
+Wer einen Kuchen mitbringen möchte, meldet sich bitte bis zum 5. Juli bei Frau Seidel.
-Nach oben
-Impressum | Datenschutz
-© 2022 Gartenverein Am Bach e. V.
===
-Accueil
-Actualités
-Contact
+Le marché change de place
+À partir du samedi 4 mai, le marché se tiendra sur la place de la gare. Les travaux de la halle dureront six mois.
+Les commerçants seront installés aux mêmes heures que d'habitude, de 8 heures à 13 heures.
+Le stationnement restera gratuit le samedi matin dans les rues voisines.
-Partager cette page
-Mentions légales | Plan du site
===
-Inicio | Noticias | Contacto
+La biblioteca amplía su horario
+La biblioteca municipal abrirá también los domingos por la mañana a partir de octubre. La medida responde a la demanda de los estudiantes.
+Durante los exámenes, la sala de lectura cerrará a medianoche.
-Leer más
-Aviso legal
-© 2021 Ayuntamiento. Todos los derechos reservados.
===
-ホーム
-お知らせ
-アクセス
-お問い合わせ
+図書館からのお知らせ
+来月から閲覧室の利用時間を一時間延長します。平日は午後八時まで開いています。
+自習席は先着順で、予約はできません。
-ページの先頭へ
-© 2020 市立図書館
===
-首页 | 新闻 | 联系我们
+新桥将于明年通车
+市政府昨天宣布，连接东西两岸的新桥将于明年六月通车。工程已经完成了八成。
+通车以后，从车站到医院只需要十分钟。
-分享
-版权所有 2022
===
-Jobs
-Log in
-Sign up
+How to prune an apple tree
+Prune in late winter, before the buds begin to swell. Choose a dry day.
+1. Remove dead and crossing branches first.
+2. Open up the middle of the tree so that light gets in.
+3. Shorten last year's growth by a third.
+Never take off more than a quarter of the crown in one year.
-Newsletter
-Get our tips by email every week. Subscribe
-Terms of use
===
-Toggle navigation
-Research
-Teaching
-People
+Soil moisture and frost: a ten-year record
+We measured soil moisture at four depths on a north-facing slope between 2009 and 2019. Frost reached 40 cm in three winters.
+Our results show that a thin cover of straw halves the depth of frost. The effect was strongest in years without snow.
+Data and code are available from the authors on request.
-Cite this page
-Privacy policy
-University of the North, Department of Geography
===
-Home
-Menu
-Find us
+About the bakery
+We bake everything on the premises, starting at three in the morning. Our sourdough is left to rise for eighteen hours.
+The flour comes from a mill eleven miles away, and the butter from the farm next door.
+On Fridays there are cinnamon buns, and they are usually gone by nine.
-12 High Street, Tarnford · Tel 01632 960101
-Follow us on Instagram
===
-Sign in
-Forum index
-Register
+Re: Bike chain keeps slipping
+I had the same problem last year. It turned out the cassette was worn, so a new chain alone did not help.
+Measure the chain first. If it has stretched by more than one percent, replace both together.
-Report this post
-Board index
-All times are UTC
===
-Cookie settings
-Products
-Support
+Release notes for version 4.2
+This version fixes a crash that happened when a file was renamed while it was open.
+Search is about twice as fast in large folders. Thumbnails are now made in the background.
+- The export dialog remembers the last folder.
+- The Polish translation is complete.
+Please restart the program after the update.
-Download
-Legal notice
===
-Travel
-Hotels
-Deals
+Three days in the lake district
+Day one is for the old town. Climb the tower early, before the coaches arrive, and have lunch by the harbour.
+On the second day take the slow ferry to the island. It leaves at ten and returns at five.
+Keep the third day free for walking; the path along the ridge is well marked.
-Popular destinations
-Weekend in Lisbon
-Rail passes explained
-Advertisement
===
-Главная
-Новости
-Контакты
+Школа открыла новый класс
+В сентябре школа открыла класс робототехники для младших учеников. Занятия проходят по вторникам и четвергам.
+Оборудование купили на средства гранта, который школа выиграла весной.
-Войти
-Политика конфиденциальности
===
-Strona główna
-Kontakt
+Nowa ścieżka rowerowa
+W maju gmina otworzy ścieżkę rowerową wzdłuż rzeki. Trasa ma dziewięć kilometrów długości.
+Na całej długości ustawiono ławki oraz tablice z mapą okolicy.
-Mapa strony
===
-Recipes
-Search
-My account
+Lentil soup with lemon
+This soup takes half an hour and needs no soaking.
+- 200 g red lentils
+- 1 onion, chopped
+- 1 lemon
+- 1 litre stock
+Fry the onion gently until soft, then add the lentils and the stock. Simmer for twenty minutes.
+Stir in the lemon juice just before serving.
-Print
-Related recipes
-Tomato soup
-Barley broth
-Contact us
===
-Skip navigation
-Museum shop
-Tickets
+Opening hours and prices
+The museum is open from Tuesday to Sunday, 10 a.m. to 6 p.m. It is closed on Mondays.
+Adults pay 9 euros. Children under twelve are free.
+Guided tours start at eleven and last about an hour.
-Back to top
-Accessibility
===
-Terms
-Home
-Login
+A reader writes
+My grandmother kept every letter she ever received, and last month we opened the box. Most were from her sister in Halifax.
+The oldest was dated 1931 and described a storm that took the roof off the barn.
-Subscribe to our newsletter
-Archives
-March 2019
-February 2019
"""

RESIDUE = [
    "Home | About | Contact\nError establishing a database connection",
    "Sorry, you have been blocked\nYou don't have permission to access this server.",
    "404 Not Found\nThe requested URL /old/page was not found on this server.",
    "Home\nShop\nOops! That page can't be found.\nIt looks like nothing was found at this location.",
    "Dear *|FNAME|*,\n*|INTRO|*\n*|CITY|*",
    "{$company.name}\nWelcome to {$company.name} in {$city}",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.\nVivamus viverra massa quis nulla tempor.",
    "Please enable JavaScript to view this page.",
    "You need to enable JavaScript to run this app.",
    "503 Service Unavailable\nPlease try again later.",
    "Страница не найдена",
    "Nie znaleziono strony",
    "페이지를 찾을 수 없습니다",
    "Just a moment...\nChecking if you are human",
    "Your text goes here.\nClick here to edit this text.",
    "Internal Server Error",
    "This site can't be reached",
    "Access denied",
    "お探しのページは見つかりませんでした。",
    "Seite nicht gefunden",
    "Page introuvable",
    "Página no encontrada",
    "Loading...\nPlease wait",
]

CONTENT = [
    "The phrase lorem ipsum comes from a work by Cicero and has been used by printers since the sixteenth century.\nIt means nothing as it stands.",
    "How to fix error 503\nThe server sends a 503 when it is too busy. Wait a minute and reload; if that fails, write to the owner of the site.",
    "Our theme shows {{ title }} at the top of each page, and the footer repeats the name of the shop in small letters for readers who scroll.",
    "Merge fields\nA merge field such as *|FNAME|* is replaced by the first name of each reader when the mail is sent.\n*|FNAME|*",
    "The gallery is closed on Mondays. Please come back later in the week, when our new exhibition opens.\n{{ banner }}",
    "We teach children to write small programs in JavaScript. No experience is needed, and laptops are provided.",
    "Der Fehler 404 erscheint, wenn eine Adresse nicht mehr stimmt. So leiten Sie alte Adressen um.",
    "[Verse 1]\nThe rain came down on the harbour town, and nobody closed the door.\n[Chorus]\nAnd the boats went out as they did before.",
]


def bodies() -> list[tuple[str, set[int]]]:
    """Text of each page with the numbers of its body lines."""
    out = []
    for page in BODIES.rstrip("\n").split("\n===\n"):
        lines = page.split("\n")
        out.append(("\n".join(x[1:] for x in lines), {n for n, x in enumerate(lines) if x[0] == "+"}))
    return out
