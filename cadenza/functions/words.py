"""The word lists and patterns that results must agree on. Patterns are in RE2's dialect; `text.rx` translates them."""

EDITION_WORDS = (
    "deluxe edition version explicit clean remaster remastered remasters bonus track tracks expanded anniversary special single ep lp album "
    "reissue digital standard extended super limited collector collectors international mono stereo hd hq cd web mp3 flac kbps hi res the and "
    "with of s us uk eu jp japan japanese делюкс издание версия сингл альбом переиздание ремастер бонус трек треки"
).split()
JUNK_NAMES = (
    "vk vkcom vkontakte вк вконтакте telegram телеграм телеграмм tg youtube youtubemusic soundcloud zaycevnet zaycev muzofond hitmo unknown "
    "unknownalbum noalbum untitledalbum неизвестныйальбом безальбома неизвестно"
).split()
FILE_QUALIFIERS = (
    "edit edited version ver cdq hq lq snippet leak leaked unreleased master mastered full clean explicit dirty audio official lyric lyrics "
    "video stem stems the and"
).split()
PLACEHOLDER_NAMES = (
    "vk vkcom vkmusic vkmp3 vkmusicru unknown unknownartist noartist none various variousartists va youtube soundcloud spotify telegram mp3 "
    "audio music музыка сборник неизвестен неизвестный неизвестныйисполнитель"
).split()
RECORDING_WORDS = (
    "session sessions studio remix mix live acoustic demo og original alt alternate extended slowed reverb sped instrumental remaster "
    "remastered take intro outro interlude skit bonus deluxe radio solo acapella capella cover reprise unplugged mono stereo short long "
    "finished unfinished verse hook chorus part pt vip rework bootleg mashup chopped screwed nightcore speed instr"
).split()
MEDIA_EXTENSIONS = (
    ".mp3 .m4a .m4b .m4p .aac .flac .alac .wav .aif .aiff .aifc .ogg .oga .opus .wma .ape .wv .mpc .dsf .dff .mka .amr .mid .midi .mp4 .m4v "
    ".mov .mkv .webm .avi .3gp .wmv"
).split()
PLAYLIST_EXTENSIONS = ".m3u .m3u8 .txt .xml .pls .xspf .wpl .zpl".split()
TIME_HEADERS = "Time Время Dauer Durée Duración Durata Duur Tid Czas Duração Čas".split()

NOT_WORD = r"[^\p{L}\p{N}]+"
DISC = r"(?i)\s*(?:[\(\[\{]\s*(?:cd|disc|disk|диск)\s*(\d+)\s*[\)\]\}]|[-–—]\s*(?:cd|disc|disk|диск)\s*(\d+))\s*$"
TRAILING_BRACKET = r"\s*[\(\[\{]([^\(\)\[\]\{\}]*)[\)\]\}]\s*$"
TRAILING_DASH = r"\s+[-–—]\s+([^-–—]+)$"
EDITION_NUMBER = r"^\d+(st|nd|rd|th)?$"
GUEST_MARKER = r"(?i)\s*[\(\[]?\s*\b(?:feat|ft|featuring|with|w/|prod\. by|vs|versus)\b\.?\s+"
BARE_SEPARATOR = r"\s*(?:\||;|\s/\s|\s[xX]\s|\s&\s|,\s)\s*"
WATERMARK = r"(?i)^(?:@|(?:https?://)?(?:www\.)?(?:t\.me|vk\.com|telegram\.me|youtu)\b)"
NOISE_CHUNK = (
    r"(?i)[\(\[]\s*(?:feat|ft|featuring|with|prod|produced)\b[^\)\]]*[\)\]]|[\(\[]\s*(?:official\b[^\)\]]*|lyrics?|audio|visuali[sz]er|"
    r"music video|video|hq|hd|explicit|clean|dirty|cdq|full|snippet|leak(?:ed)?|unreleased|og|master(?:ed)?|remaster(?:ed)?[^\)\]]*)\s*[\)\]]"
)
NOISE_SUFFIX = r"(?i)\s+-\s+(?:remaster(?:ed)?|single version|album version|radio edit|bonus track|deluxe)\b.*$"
LEADING_NUMBER = r"^\s*\d{1,3}\s*[-.)]\s+"
PRODUCER_SUFFIX = r"(?i)\s+[-–—|]?\s*(?:prod\.\s*(?:by\s+)?|prod\s+by\s+|produced\s+by\s+)\S.*$"
GUEST_SUFFIX = r"(?i)\s+(?:\b(?:feat|ft|featuring|w/)\b\.?|п\.\s?у\.?|при участии|совместно с)\s+"
GUEST_CREDIT = r"(?i)[\(\[]?\s*(?:\b(?:feat|ft|featuring|with)\b\.?|п\.\s?у\.?|при участии)\s+"
ASIDE = r"[\(\[][^\)\]]*[\)\]]"
VERSION_SUFFIX = r"(?i)\s+(?:v\.?\d+|og|stem|stems|solo|snippet|master|cdq)$"
VERSION_WORD = r"^v\d+$"
HANDLE = r"(?i)\s*[|,;]?\s*(?:@\S+|(?:https?://)?(?:www\.)?(?:t\.me|vk\.com|telegram\.me)/\S*)\s*"
GUEST_SEPARATOR = r"\s*(?:&|,|;|\+|\band\b|\bи\b)\s*"
TRANSLATION = r"\s*[(\[]([^()\[\]]*)[)\]]\s*$"
STUDIO_WORD = r"(?i)^(?:bpm|\d+bpm|stems?|mix|mixed|master(?:ed)?|prod|produced|session|sessions|cdq|snippet|v\d+|ver|version|edit|final|rough)$"
PLAIN_NUMBER = r"^\d{1,4}$"
LRC_TIME = r"^\s*((?:\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\])+)\s*(.*)$"
LRC_CREDIT = (
    r"(?i)^(?:作词|作曲|编曲|制作人?|混音|母带|录音|和声|监制|出品|发行|企划|统筹|吉他|贝斯|鼓|键盘|弦乐|词|曲|lyricist|lyrics by|composer|composed by|arranger|"
    r"producer|produced by|mix(?:ed|ing)?(?: by)?|master(?:ed|ing)?(?: by)?|recording)\s*[:：]"
)
LRC_INSTRUMENTAL = r"纯音乐|此歌曲为没有填词的纯音乐"
DECLARED_LYRICS = r'"lyrics"\s*:\s*\{[^{}]*?"(?:text|body)"\s*:\s*("(?:[^"\\]|\\.)*")'
HIDDEN_MARKUP = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<!--.*?-->"
SECTION_TAG = r"(?i)</?(?:div|section|article|aside|main|header|footer|nav|ul|ol|li|table|tr|td|h[1-6]|form|button|iframe|body)\b[^>]*>"
EMPTY_ELEMENT = r"(?i)<(?:div|ins|aside|section|span)\b[^>]*>\s*</(?:div|ins|aside|section|span)>"
SOURCE_BREAK = r"[ \t]*[\r\n]+[ \t]*"
LINE_BREAK = r"(?i)<br\s*/?>"
BLOCK_END = r"(?i)</(?:div|p)>"
PARA_END = r"(?i)</p>"
ANY_TAG = r"<[^>]*>"
LYRICS_CONTAINER = r'(?i)<div[^>]*\bdata-lyrics-container="true"[^>]*>'
EXCLUDED_BLOCK = r'(?i)<div[^>]*\bdata-exclude-from-selection="true"[^>]*>'
DIV_TAG = r"(?i)<(/?)div\b"
AZLYRICS_START = r"(?i)<!--[^>]*Usage of azlyrics\.com content"
AMALGAMA_LINE = r'(?is)<div class="original">(.*?)</div>'
LINK_TAG = r"(?i)<a\b"
SLUG_BREAK = r"[^a-z0-9]+"
PLS_LINE = r"(?i)^\s*(File|Title|Length)(\d+)\s*=(.*)$"

#: Thresholds and caps of matching, of names shared by albums, and of tags.
MIN_SCORE, MENTION_SCORE, NAME_SCORE, MAX_ATTEMPTS, HOOK_REPEATS = 0.62, 0.45, 0.85, 5, 3
SHARED_ARTISTS, TAG_LIMIT, PREVIEW_ROWS, BROKEN_LINES = 3, 3145728, 400, 4
SITES = {"genius.com": "Genius", "amalgama-lab.com": "Amalgama", "azlyrics.com": "AZLyrics", "musixmatch.com": "Musixmatch", "letras.mus.br": "Letras", "letras.com": "Letras", "songlyrics.com": "SongLyrics", "lyricstranslate.com": "LyricsTranslate"}
