"""Word lists and header names. All of these are fixed values; pass your own for other entities or languages."""

# Keywords that make an article relevant.
RELEVANT = (
    "삼성전자", "삼성", "갤럭시", "스마트폰", "반도체", "DRAM", "NAND", "디스플레이",
    "애플", "아이폰", "아이패드", "맥북", "애플워치", "에어팟",
)

# Ordered rules of the first-match tagger.
FIRST_MATCH = (("samsung", ("삼성전자", "삼성")), ("apple", ("애플",)))

# Keywords counted by the voting tagger.
VOTES = {
    "samsung": ("삼성전자", "삼성", "samsung", "갤럭시", "galaxy", "sdi", "반도체", "dram", "nand"),
    "apple": ("애플", "apple", "아이폰", "iphone", "아이패드", "ipad", "맥북", "macbook", "ios", "macos"),
}

# Accepted headers of a raw news file, in order of preference.
NEWS_HEADERS = {
    "news_id": ("뉴스 식별자", "뉴스식별자", "news_id", "ID"),
    "date": ("일자", "날짜", "date", "일시"),
    "publisher": ("언론사", "신문사", "media", "출처"),
    "title": ("제목", "title"),
    "body": ("본문", "content"),
    "url": ("URL", "url"),
    "keywords": ("키워드", "keyword"),
}

# Fragments by which a header is recognised when names vary freely.
NEWS_FRAGMENTS = {
    "date": ("일자", "날짜", "date"),
    "title": ("제목", "title"),
    "keywords": ("키워드", "keyword"),
    "body": ("본문", "content", "내용"),
    "publisher": ("언론사", "매체", "media"),
}
