"""Host rules held as data: admission, harvest and page caps."""

from __future__ import annotations

#: Hosts (and all below them) whose pages are admitted.
ALLOWED = frozenset(
    """
    dev.to fly.io go.dev beej.us docs.rs jvns.ca lwn.net llvm.org redis.io thume.ca abseil.io arxiv.org jepsen.io
    owasp.org swtch.com uops.info danluu.com hexdocs.pm isocpp.org medium.com nodejs.org norvig.com sqlite.org
    sre.google clojure.org distill.pub gcc.gnu.org grafana.com ocw.mit.edu ziglang.org 12factor.net cacm.acm.org
    coq.inria.fr dropbox.tech eng.uber.com explained.ai sandpile.org staffeng.com faultlore.com kubernetes.io
    prometheus.io without.boats www.agner.org www.infoq.com ask.ubuntu.com aws.amazon.com book.rvemu.app
    clang.llvm.org cryptopals.com docs.swift.org kotlinlang.org paulgraham.com techcrunch.com thenewstack.io
    www.elastic.co www.interdb.jp www.kernel.org www.usenix.org cs.stanford.edu docs.docker.com docs.oracle.com
    docs.python.org elixir-lang.org learnopengl.com os.phil-opp.com portswigger.net quantum.country
    research.google webassembly.org www.haskell.org www.oreilly.com xavierleroy.org blog.acolyer.org
    cppreference.com cs231n.github.io docs.ansible.com en.wikipedia.org kafka.apache.org learn.qiskit.org
    martinfowler.com microservices.io nlp.stanford.edu opentelemetry.io systemdesign.one wiki.haskell.org
    www.cl.cam.ac.uk www.schneier.com www.terraform.io cp-algorithms.com doc.rust-lang.org hacks.mozilla.org
    matklad.github.io pages.cs.wisc.edu simonwillison.net slack.engineering stackoverflow.com blog.rust-lang.org
    docs.julialang.org engineering.fb.com paperswithcode.com pdos.csail.mit.edu rachelbythebay.com
    stackoverflow.blog www.cs.cornell.edu www.databricks.com www.postgresql.org blog.cloudflare.com
    docs.scala-lang.org en.cppreference.com highscalability.com learn.microsoft.com netflixtechblog.com
    shopify.engineering vulkan-tutorial.com www.nand2tetris.org martin.kleppmann.com news.ycombinator.com
    people.csail.mit.edu raytracing.github.io www.brendangregg.com developer.mozilla.org eli.thegreenplace.net
    missing.csail.mit.edu www.cockroachlabs.com homotopytypetheory.org interrupt.memfault.com
    unix.stackexchange.com www.joelonsoftware.com 15445.courses.cs.cmu.edu 15721.courses.cs.cmu.edu
    craftinginterpreters.com engineering.linkedin.com www.linuxfromscratch.org developers.googleblog.com
    lamport.azurewebsites.net muratbuffalo.blogspot.com cheatsheetseries.owasp.org cstheory.stackexchange.com
    www.scattered-thoughts.net blog.cryptographyengineering.com softwarefoundations.cis.upenn.edu
    """.split()
)

#: Hosts (and all below them) whose links are taken from link aggregators.
HARVESTED = frozenset(
    """
    dev.to fly.io go.dev nee.lv pvk.ca acm.org beej.us docs.rs jvns.ca lwn.net llvm.org mrale.ph ralfj.de redis.io
    rxweb.io thume.ca write.as zig.news abseil.io agner.org aphyr.com arxiv.org infoq.com jepsen.io lobste.rs
    okmij.org owasp.org pling.app swtch.com tollef.no tonsky.me tratt.net uops.info cs.cmu.edu cs.nyu.edu
    danluu.com elastic.co github.com hexdocs.pm interdb.jp isocpp.org kernel.org maskray.me medium.com nodejs.org
    norvig.com sqlite.org sre.google timlrx.com usenix.org www.pvk.ca zserge.com apenwarr.ca borretti.me
    distill.pub gcc.gnu.org grafana.com justine.lol mcyoung.xyz mort.coffee ocw.mit.edu oreilly.com snoyman.com
    ziglang.org cacm.acm.org cl.cam.ac.uk coq.inria.fr dropbox.tech eng.uber.com explained.ai preshing.com
    sandpile.org schneier.com staffeng.com terraform.io timharris.uk verdagon.dev wingolog.org www.tweag.io
    bitbashing.io faultlore.com gamasutra.com hugotunius.se jeremykun.com kubernetes.io luca.ntop.org
    neugierig.org prometheus.io without.boats ask.ubuntu.com aws.amazon.com book.rvemu.app clang.llvm.org
    cppstories.com cryptopals.com cs.cornell.edu databricks.com docs.swift.org hn.algolia.com kotlinlang.org
    overreacted.io paulgraham.com postgresql.org thenewstack.io www.usenix.org blog.golang.org blog.regehr.org
    corecursive.com cs.stanford.edu docs.docker.com docs.oracle.com docs.python.org elixir-lang.org
    fasterthanli.me jakewharton.com learnopengl.com nand2tetris.org nullprogram.com os.phil-opp.com
    portswigger.net quantum.country research.google webassembly.org www.cs.yale.edu xavierleroy.org
    blog.acolyer.org brendangregg.com cppreference.com cs231n.github.io docs.ansible.com en.wikipedia.org
    gankra.github.io golangweekly.com gregoryszorc.com jameshfisher.com johnnysswlab.com kafka.apache.org
    log.annulled.net martinfowler.com microservices.io nlp.stanford.edu opentelemetry.io systemdesign.one
    thorstenball.com wiki.haskell.org words.filippo.io www.aosabook.org www.tedinski.com blog.jessfraz.com
    cockroachlabs.com cp-algorithms.com doc.rust-lang.org hacks.mozilla.org matklad.github.io pages.cs.wisc.edu
    simonwillison.net slack.engineering stackoverflow.com www.hyrumslaw.com blog.rust-lang.org docs.julialang.org
    engineering.fb.com joelonsoftware.com lxr.sourceware.org paperswithcode.com pdos.csail.mit.edu
    rachelbythebay.com ridiculousfish.com stackoverflow.blog sunfishcode.online blog.cloudflare.com
    docs.scala-lang.org en.cppreference.com ferrous-systems.com highscalability.com jhjourdan.mketjh.fr
    learn.microsoft.com netflixtechblog.com shopify.engineering thecodelesscode.com vulkan-tutorial.com
    www.cs.virginia.edu www.hillelwayne.com www.theregister.com codewithoutrules.com linuxfromscratch.org
    martin.kleppmann.com mulle-kybernetik.com oxfeeefeee.github.io raytracing.github.io robert.ocallahan.org
    tenderlovemaking.com developer.mozilla.org eli.thegreenplace.net fgiesen.wordpress.com jasonlaster.github.io
    kristerw.blogspot.com missing.csail.mit.edu swlaschin.gitbooks.io univalent.foundations www.pathsensitive.com
    homotopytypetheory.org interrupt.memfault.com scattered-thoughts.net smallcultfollowing.com
    unix.stackexchange.com wordsandbuttons.online browserengineering.book 15445.courses.cs.cmu.edu
    15721.courses.cs.cmu.edu craftinginterpreters.com engineering.linkedin.com lamport.azurewebsites.net
    muratbuffalo.blogspot.com nickdesaulniers.github.io commandcenter.blogspot.com cstheory.stackexchange.com
    www.destroyallsoftware.com blog.cryptographyengineering.com softwarefoundations.cis.upenn.edu
    """.split()
)

#: Pages kept of a host, by exact name.
CAPS = {
    host: cap
    for cap, hosts in {
        200: """
            quantum.country
        """,
        500: """
            swtch.com uops.info explained.ai www.agner.org book.rvemu.app cryptopals.com www.interdb.jp
            cs231n.github.io raytracing.github.io missing.csail.mit.edu community.databricks.com
            explore.alas.aws.amazon.com
        """,
        1000: """
            thume.ca 12factor.net sandpile.org staffeng.com faultlore.com circt.llvm.org techcrunch.com
            os.phil-opp.com webassembly.org xavierleroy.org www.databricks.com vulkan-tutorial.com
            www.nand2tetris.org 15445.courses.cs.cmu.edu 15721.courses.cs.cmu.edu craftinginterpreters.com
            lamport.azurewebsites.net www.scattered-thoughts.net
        """,
        2000: """
            beej.us abseil.io jepsen.io norvig.com coq.inria.fr paulgraham.com learnopengl.com learn.qiskit.org
            www.cl.cam.ac.uk pages.cs.wisc.edu pdos.csail.mit.edu martin.kleppmann.com news.ycombinator.com
            homotopytypetheory.org www.linuxfromscratch.org blog.cryptographyengineering.com
        """,
        3000: """
            dev.to fly.io medium.com distill.pub without.boats thenewstack.io microservices.io nlp.stanford.edu
            hacks.mozilla.org matklad.github.io www.joelonsoftware.com
        """,
        5000: """
            jvns.ca danluu.com isocpp.org clojure.org dropbox.tech www.infoq.com ask.ubuntu.com elixir-lang.org
            www.haskell.org systemdesign.one www.schneier.com cp-algorithms.com simonwillison.net
            slack.engineering blog.rust-lang.org rachelbythebay.com stackoverflow.blog www.cs.cornell.edu
            highscalability.com shopify.engineering www.brendangregg.com eli.thegreenplace.net
            www.cockroachlabs.com interrupt.memfault.com unix.stackexchange.com muratbuffalo.blogspot.com
            softwarefoundations.cis.upenn.edu
        """,
        8000: """
            gcc.gnu.org grafana.com ziglang.org cacm.acm.org eng.uber.com aws.amazon.com clang.llvm.org
            www.elastic.co research.google www.oreilly.com blog.acolyer.org martinfowler.com engineering.fb.com
            netflixtechblog.com people.csail.mit.edu engineering.linkedin.com developers.googleblog.com
            cheatsheetseries.owasp.org cstheory.stackexchange.com
        """,
        10000: """
            redis.io owasp.org sqlite.org sre.google prometheus.io docs.swift.org kotlinlang.org www.usenix.org
            cs.stanford.edu portswigger.net kafka.apache.org opentelemetry.io wiki.haskell.org
            docs.julialang.org paperswithcode.com blog.cloudflare.com docs.scala-lang.org
        """,
        12000: """
            en.wikipedia.org
        """,
        15000: """
            lwn.net llvm.org nodejs.org ocw.mit.edu docs.docker.com docs.ansible.com www.terraform.io
        """,
        20000: """
            go.dev hexdocs.pm kubernetes.io www.kernel.org docs.oracle.com stackoverflow.com www.postgresql.org
        """,
        25000: """
            arxiv.org docs.python.org cppreference.com doc.rust-lang.org ch.cppreference.com en.cppreference.com
            learn.microsoft.com
        """,
        30000: """
            docs.rs developer.mozilla.org
        """,
    }.items()
    for host in hosts.split()
}

#: Pages kept of a host and all below it, where no exact name says otherwise; none contains another.
SUFFIX_CAPS = {
    host: cap
    for cap, hosts in {
        500: "interdb.jp",
        1000: "nand2tetris.org scattered-thoughts.net",
        2000: "cl.cam.ac.uk linuxfromscratch.org",
        3000: "databricks.com joelonsoftware.com",
        5000: "infoq.com cs.cornell.edu brendangregg.com cockroachlabs.com",
        8000: "elastic.co",
        10000: "usenix.org haskell.org",
        15000: "terraform.io",
        20000: "kernel.org postgresql.org",
    }.items()
    for host in hosts.split()
}
DEFAULT_CAP = 2000
