"""Word lists and dictionaries. Dictionaries are parameters everywhere; what stands here are defaults."""

from __future__ import annotations

# Topic names and the keywords that raise them.
TOPICS: dict[str, list[str]] = {
    "AI": ["artificial intelligence", "machine learning", "deep learning", "neural network", "gpt", "openai", "anthropic", "claude", "llm", "chatgpt", "ai model", "ai agent"],
    "markets": ["stock market", "nasdaq", "s&p", "dow jones", "bull market", "bear market", "recession", "inflation", "interest rate", "fed rate", "earnings", "ipo", "spac", "valuation"],
    "crypto": ["bitcoin", "ethereum", "crypto", "blockchain", "defi", "stablecoin", "web3", "nft", "token"],
    "politics": ["election", "president", "congress", "senate", "democrat", "republican", "trump", "biden", "kamala", "policy", "regulation", "legislation", "doge"],
    "foreign_policy": ["china", "russia", "ukraine", "iran", "nato", "tariff", "trade war", "sanctions", "geopolitics", "middle east", "israel", "gaza"],
    "startups": ["startup", "venture capital", "series a", "fundrais", "founder", "unicorn", "seed round", "angel invest"],
    "enterprise": ["saas", "enterprise", "b2b", "cloud", "platform", "microsoft", "google", "salesforce", "oracle"],
    "science": ["science corner", "research", "clinical trial", "biology", "physics", "chemistry", "genome", "crispr", "breakthrough"],
    "energy": ["energy", "nuclear", "solar", "oil", "natural gas", "renewable", "climate", "carbon"],
    "media": ["media", "journalism", "podcast", "content", "creator", "streaming", "netflix", "youtube", "twitter", "social media"],
}

# Words without signal in ranked retrieval.
RETRIEVAL_STOPWORDS: tuple[str, ...] = tuple(
    """
    what would will about think they this that from
    have been should could does with going their then
    than them when where there these those here into
    just like over some such take very much each
    make most said says back been were was are
    you the and for but not has had who why
    how all any can did get got her him his
    its let out see she too two use way
    bestie besties show
    """.split()
)

# Words without signal in keyword search.
KEYWORD_STOPWORDS: tuple[str, ...] = tuple(
    """
    the and for are but not you all
    can has her was one our out day had has his
    how its may new now old see way who boy did
    get let say she too use what when where which
    will with would could should about think they this
    that from have been were some them than each make
    like just over such take into very much does going
    """.split()
)
