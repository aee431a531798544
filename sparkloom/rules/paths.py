"""Path, query and scoring rules held as data."""

from __future__ import annotations

BINARY = "7z bz2 gif gz jpeg jpg mp3 mp4 pdf png svg tar tar.gz tgz ttf webp woff woff2 xz zip".split()
HARVEST_BINARY = "gif gz jpeg jpg mp3 mp4 pdf png svg tar ttf woff woff2 zip".split()
LOCALES = "cs da de es fi fr hu it ja ko nl no pl pt ro ru sv tr uk zh".split()
LANGUAGE_MARKS = ["lang=", "locale=", *[f"/{x}/" for x in "de-de es-ar fr-fr it-it ja-jp ko-kr pt-br ru-ru uk-ua zh-cn zh-tw".split()]]

WIKI_TOPICS = (
    "algorithm artificial_intelligence compiler computer computer_science crypt data_structure database deep_learning distributed "
    "internet interpreter kernel linux machine_learning network neural_network open_source operating_system programming protocol "
    "software unix web_"
).split()
WIKI_OFF_TOPIC = "_championship _cup _in_ _league _season basketball election football olympics".split()
MEDIUM_PAGES = "about followers following help m/signin m/signout me membership search tag/ topics".split()
BLOCKED_PARAMS = (
    "action answertab diff fbclid gclid lastactivity mc_cid mc_eid oldid printable ref ref_src search source tab veaction".split()
)

HIGH_SIGNAL = "api articles blog docs guide manual news post reference tutorial wiki".split()
LOW_SIGNAL = "archive/ blob/ category/ commit/ diff/ index/ page/ raw/ rev- search/ source/ tag/ v-".split()
TOP_HOSTS = "docs.rs docs.python.org doc.rust-lang.org en.wikipedia.org developer.mozilla.org en.cppreference.com".split()
