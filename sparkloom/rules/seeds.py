"""Where a crawl begins, without the scheme."""

from __future__ import annotations

SEEDS = """
    12factor.net/ 15445.courses.cs.cmu.edu/fall2024/ 15721.courses.cs.cmu.edu/spring2024/ abseil.io/docs/cpp/ arxiv.org/list/cs.DC/recent
    arxiv.org/list/cs.DS/recent arxiv.org/list/cs.LG/recent ask.ubuntu.com/ aws.amazon.com/blogs/architecture/ beej.us/guide/bgc/html/
    beej.us/guide/bgnet/html/ blog.acolyer.org/ blog.cloudflare.com/ blog.cryptographyengineering.com blog.rust-lang.org/ book.rvemu.app cacm.acm.org/
    cheatsheetseries.owasp.org/ clang.llvm.org/docs/ clojure.org/reference/ coq.inria.fr/documentation cp-algorithms.com cppreference.com/
    craftinginterpreters.com/contents.html cryptopals.com cs.stanford.edu/ cs231n.github.io cstheory.stackexchange.com/questions danluu.com/ dev.to/
    developer.mozilla.org/en-US/docs/Web/JavaScript developers.googleblog.com/ distill.pub/ doc.rust-lang.org/ doc.rust-lang.org/nomicon/
    doc.rust-lang.org/reference/ doc.rust-lang.org/rust-by-example/ docs.ansible.com/ docs.docker.com/ docs.julialang.org/en/v1/
    docs.oracle.com/en/java/javase/21/docs/api/ docs.python.org/3/ docs.rs/tokio/latest/tokio/ docs.scala-lang.org/ docs.swift.org/swift-book/
    dropbox.tech/ eli.thegreenplace.net elixir-lang.org/docs.html en.wikipedia.org/wiki/Algorithm en.wikipedia.org/wiki/Compiler
    en.wikipedia.org/wiki/Computer_network en.wikipedia.org/wiki/Computer_science en.wikipedia.org/wiki/Data_structure en.wikipedia.org/wiki/Database
    en.wikipedia.org/wiki/Distributed_computing en.wikipedia.org/wiki/Machine_learning en.wikipedia.org/wiki/Operating_system
    en.wikipedia.org/wiki/Programming_language eng.uber.com/ engineering.fb.com/ explained.ai faultlore.com/blah/ fly.io/blog/
    gcc.gnu.org/onlinedocs/gcc/ go.dev/doc/ grafana.com/blog/ hacks.mozilla.org hexdocs.pm/elixir/ highscalability.com/ homotopytypetheory.org/book/
    interrupt.memfault.com/blog isocpp.org/faq jepsen.io/analyses jvns.ca/ kafka.apache.org/documentation/ kotlinlang.org/docs/
    kubernetes.io/docs/home/ lamport.azurewebsites.net/tla/tla.html learn.microsoft.com/en-us/dotnet/ learn.qiskit.org learnopengl.com llvm.org/docs/
    lwn.net/Kernel/Index/ martin.kleppmann.com martinfowler.com/ matklad.github.io/ medium.com/tag/programming microservices.io/patterns/
    missing.csail.mit.edu muratbuffalo.blogspot.com netflixtechblog.com/ news.ycombinator.com/ nlp.stanford.edu/IR-book/html/htmledition/
    nodejs.org/en/docs/ norvig.com ocw.mit.edu/courses/electrical-engineering-and-computer-science/ opentelemetry.io/docs/ os.phil-opp.com
    owasp.org/www-project-top-ten/ pages.cs.wisc.edu/~remzi/OSTEP/ paperswithcode.com/ paulgraham.com/articles.html
    pdos.csail.mit.edu/6.828/2023/schedule.html people.csail.mit.edu/ portswigger.net/web-security prometheus.io/docs/ quantum.country/qcvc
    rachelbythebay.com/w/ raytracing.github.io redis.io/docs/ research.google/blog/ sandpile.org shopify.engineering/ simonwillison.net/
    slack.engineering/ softwarefoundations.cis.upenn.edu sqlite.org/docs.html sre.google/sre-book/ sre.google/workbook/
    stackoverflow.com/questions/tagged/algorithms staffeng.com/guides/ swtch.com/~rsc/regexp/ systemdesign.one/
    techcrunch.com/category/artificial-intelligence/ thenewstack.io/ thume.ca unix.stackexchange.com/ uops.info/table.html vulkan-tutorial.com
    webassembly.org wiki.haskell.org/ without.boats/blog/ www.agner.org/optimize/ www.brendangregg.com/blog/index.html
    www.cl.cam.ac.uk/~pes20/weakmemory/ www.cockroachlabs.com/blog/ www.cs.cornell.edu/courses/cs6120/2020fa/blog/ www.databricks.com/blog/engineering
    www.elastic.co/blog/ www.haskell.org/documentation/ www.infoq.com/ www.interdb.jp/pg/ www.joelonsoftware.com/ www.kernel.org/doc/html/latest/
    www.linuxfromscratch.org/lfs/view/stable/ www.nand2tetris.org/course www.oreilly.com/radar/ www.postgresql.org/docs/ www.scattered-thoughts.net
    www.schneier.com/blog/ www.terraform.io/docs/ www.usenix.org/publications/proceedings/ xavierleroy.org ziglang.org/documentation/
""".split()
