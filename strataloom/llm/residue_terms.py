"""Wording of template residue and error pages: fixed values, lower case and without accents."""

#: Messages that are residue whatever words follow (the output of a crashed program).
OPEN: dict[str, list[str]] = {
    "error": [
        r"traceback \(most recent call last\)",
        r"^(uncaught )?(fatal|parse|syntax|type|reference|key|value|runtime|internal) ?error: ",
        r"^(uncaught )?(typeerror|referenceerror|keyerror|syntaxerror|valueerror|nullpointerexception)\b",
        r"call to (undefined|a member) function",
        r"^application error: a (server|client)-side exception",
        r"^warning: (mysqli?|include|require|undefined)\b",
        r"stack trace:",
    ],
}

#: Messages that are residue if every other word is a plain one.
CUES: dict[str, list[str]] = {
    "error": [
        r"\b(4\d\d|5\d\d)\b.{0,120}\b(not found|forbidden|unauthori[sz]ed|bad request|gone|conflict|too many requests|server error|bad gateway|unavailable|time-?out|not allowed|denied|error)\b",
        r"\b(not found|forbidden|unauthori[sz]ed|error|fehler|erreur)\b.{0,120}\b(4\d\d|5\d\d)\b",
        r"^<num> (not found|forbidden|gone|unauthori[sz]ed)",
        r"\b(page|site|url|article|document|resource|file|address|topic|entry|content|host|domain)\b.{0,120}\b(not found|not exist|not available|unavailable|no longer|has moved|was moved|been moved|not be found|can'?t be (found|reached|displayed)|cannot be (found|reached|displayed)|removed|deleted|expired)\b",
        r"\b(can'?t|cannot|could ?n[o']t|unable to) (find|locate|reach|load|display|open)\b.{0,120}\b(page|site|url|article|document|resource|file|server|host|content)\b",
        r"\b(page|article|document|file|resource) (you|that you) .{0,120}\b(not|no longer|moved)\b",
        r"^(page |file |document )?not found$", r"\bnothing (to see |was |is )?(here|found)\b",
        r"\bno such (page|article|file|document|topic|entry|host|resource)\b",
        r"\b(something|things) went wrong\b", r"\berror (has )?occurred\b", r"\b(unexpected|unknown|internal|server|application|database|fatal|runtime|system|gateway) (server )?error\b", r"^(error|oops|whoops|forbidden|unauthori[sz]ed)$",
        r"\bconnection (was |has )?(refused|timed out|reset|closed|lost)\b", r"\btimed? ?-?out\b", r"\berr[_ -]?(<num>|\d+|[a-z]+_[a-z_]+)\b", r"\berr_<num>", r"\b(request|access|connection|visit) (was |is |has been )?(blocked|rejected|refused)\b",
        r"\b(access|permission) (was |is |has been )?(denied|forbidden|restricted)\b", r"\b(don'?t|do not) have (permission|access)\b", r"\bnot authori[sz]ed\b", r"\byou have been blocked\b",
        r"\btoo many requests\b", r"\brate limit (exceeded|reached)\b", r"\b(service|server|site|page) (is )?(temporarily |currently )?(unavailable|overloaded|down|offline)\b",
        r"\b(under|down for|undergoing|scheduled|in) maintenance\b", r"\bmaintenance$", r"\bbe (right )?back (soon|shortly|later)\b", r"\bback soon\b", r"\btry again (later|in a)\b",
        r"\bseite (wurde |konnte |ist )?nicht (gefunden|verfugbar|erreichbar)\b", r"\bfehler (ist )?aufgetreten\b", r"\b(zugriff|zugang) verweigert\b", r"\bnicht gefunden\b", r"\bwartungs(arbeiten|modus)\b", r"\b(etwas|da) ist (etwas )?schief", r"\bexistiert nicht\b",
        r"\bpage (est )?introuvable\b", r"\bintrouvable\b", r"\berreur (est survenue|s'est produite|interne|inconnue)\b", r"\bacces (refuse|interdit)\b", r"\bn'existe (pas|plus)\b", r"\ben maintenance\b", r"\bsite indisponible\b", r"\bmal passe\b",
        r"\bpagina (no )?(encontrada|existe|disponible)\b", r"\bno encontrad[ao]\b", r"\b(ha ocurrido|se ha producido|se produjo|ocurrio) un error\b", r"\bacceso (denegado|prohibido)\b", r"\balgo (salio|ha salido|fue) mal\b", r"\ben mantenimiento\b", r"\bno disponible\b",
    ],
    "script": [
        r"\b(enable|activate|allow|turn on|switch on|require|requires|required|need|needs|disabled|turned on|switched on|without|support|supports|run|accept)\b.{0,120}\b(javascript|scripts?|cookies?|js)\b",
        r"\b(javascript|scripts?|cookies?|js)\b.{0,120}\b(required|disabled|enabled|needed|necessary|off|on|blocked|supported|enable|must)\b",
        r"^noscript\b", r"\b(aktivieren|einschalten|erforderlich|benotigt|deaktiviert|erlauben)\b.{0,120}\b(javascript|cookies?|skripte)\b", r"\b(javascript|cookies?|skripte)\b.{0,120}\b(aktivieren|einschalten|erforderlich|benotigt|deaktiviert|erlauben)\b",
        r"\b(activer|activez|autoriser|requis|necessaire|desactive|necessite)\b.{0,120}\b(javascript|cookies?|scripts?)\b", r"\b(javascript|cookies?|scripts?)\b.{0,120}\b(activer|requis|necessaire|desactive)\b",
        r"\b(activa|active|activar|habilita|habilite|habilitar|necesita|requiere|permite)\b.{0,120}\b(javascript|cookies?|scripts?)\b", r"\b(javascript|cookies?|scripts?)\b.{0,120}\b(activado|necesario|desactivado|requerido)\b",
        r"\bchecking (if )?(the site connection|your browser|you are)\b", r"^(just|only|please wait|wait) (a|one) (moment|second|minute)\b", r"^please wait$", r"^un (momento|instant|moment)\b", r"^einen (moment|augenblick)\b", r"\b(verify|confirm|prove|check) (that )?(you are|you're) (a )?(human|not a (ro)?bot)\b", r"\b(are|not) (you )?a robot\b",
        r"\battention required\b", r"\bone more step\b", r"\bddos protection\b", r"\b(security|browser) check\b", r"\bcaptcha\b", r"\bcloudflare\b", r"\byour browser (is|does|has|seems|looks)\b", r"\b(unsupported|outdated|old) browser\b",
        r"\bihr browser\b", r"\bvotre navigateur\b", r"\b(su|tu) navegador\b",
    ],
    "filler": [
        r"\blorem ipsum\b", r"\bdummy (text|description|content|title|page|copy)\b", r"\b(placeholder|filler|sample|example|demo|default|boilerplate) (text|paragraph|description|title|content|headline|copy|page)\b",
        r"\b(to be|will be) (replaced|filled|added|written|determined|announced|defined)\b", r"\breplace (this|me|with|the)\b", r"\b(your|the|page|site|meta|add|insert|enter|put) .{0,120}\b(here|goes here|go here)\b", r"\b(title|description|text|content|headline|heading|copy) goes here\b",
        r"^\W*(todo|tbd|tba|tbc|fixme|xxx|wip)\b", r"\bcoming soon\b", r"^\W*untitled\b", r"^new (page|document|post|site|file)$", r"^(add|insert|enter|write|type) (a |your |the )?(meta )?(description|title|text|content|headline)\b", r"\b(change ?me|edit me|delete me)\b",
        r"^no (title|description)( provided| available| yet| set| given)?$", r"\bhello world\b", r"\bunder construction\b", r"\bjust another .{0,120}\b(site|blog|page|website)\b", r"\bquick brown fox\b", r"^(my|the|your) (page|site|blog|website|app|title)( title| name)?$", r"^(page|document|site|meta) (title|description|name)$",
        r"\bblindtext\b", r"\bplatzhalter(text)?\b", r"\bmustertext\b", r"\bhier (steht|kommt|folgt|entsteht)\b", r"\bin kurze\b", r"\bim aufbau\b", r"^ohne titel\b",
        r"\btexte? (de remplissage|factice|d'exemple)\b", r"\bfaux texte\b", r"\ba remplacer\b", r"\bbientot (disponible|en ligne)\b", r"\ben construction\b", r"^sans titre\b", r"\bvotre (texte|titre|description) ici\b",
        r"\btexto (de relleno|de ejemplo|de prueba|simulado)\b", r"\bproximamente\b", r"\ben construccion\b", r"^sin titulo\b", r"\b(su|tu) (texto|titulo|descripcion) aqui\b",
    ],
}

#: Words that a message of these kinds may hold besides its cue.
PLAIN = """a an the this that these those your you we us our ours it its i'm we're you're is are was were has have had be been being will would can can't cannot could couldn't may must should shall not no do does did
doesn't don't didn't isn't won't to of for in into on at by from with without and or but if as so than then yet please try trying again later soon back here there now right away shortly shorty moment moments second seconds minute minutes
wait go goes going gone come continue continuing proceed proceeds view viewing run runs use using work works works properly open close reload refresh return visit visiting home homepage
page pages site sites website websites web app apps application applications server servers service services url urls link links address requested request requests resource resources content document documents file files article articles
title titles description descriptions text texts paragraph paragraphs headline name browser browsers javascript js script scripts noscript cookie cookies error errors oops sorry hm hmm uh oh ooops whoops exception exceptions problem problems
moved move exist exists longer found find finding looking looks look like seem seems temporarily currently unavailable available reached reach connection connect host domain access accessing permission denied forbidden allowed allow
human humans robot robots bot verify verifying verified check checking checked before after more step steps required requires require need needs needed enable enabled enabling disable disabled activate activated turn turned switch switched
off show shown shows stay stays empty blank display displayed load loaded loads loading contact administrator admin support digest code id ray status reference incident exception server-side client-side occurred occur happened went wrong
bad gateway internal timeout timed out too many slow down maintenance scheduled under over block blocked security protection attention one full fully correctly unable locate expired deleted removed unexpected unknown
placeholder dummy sample filler layout purposes purpose only replace replaced replacing own meta launch add insert enter put write your goes lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna aliqua todo tbd tba coming untitled another just new default example blog test company
die der das den dem des ein eine einen einem ist sind war wurde wird werden nicht kein keine ihr ihre ihren sie wir uns unser diese dieser dieses seite seiten website webseite zugriff zugang verweigert gefunden fehler aufgetreten bitte versuchen spater erneut noch einmal bald hier steht text titel beschreibung im in auf zu und oder mit fur um aktivieren verfugbar erreichbar wartung wartungsarbeiten moment augenblick browser anzeigen fortfahren blindtext platzhalter existiert mehr leider konnte etwas schief gelaufen
le la les un une des du de cette ce cet est sont etait a ete pas plus votre vos notre nous vous page site erreur produite survenue acces refuse interdit introuvable trouvee veuillez activer activez javascript pour continuer afficher reessayer tard bientot disponible texte titre description remplissage remplacer ici maintenance navigateur n'existe demandee oups desole que en et ou
el los las un una esta este es son fue ha sido no su sus tu tus nuestro pagina sitio error ocurrido acceso denegado encontrada encontrado existe activa activar habilita para ver continuar intente intentalo nuevo mas tarde pronto disponible texto titulo descripcion relleno aqui mantenimiento navegador solicitada lo sentimos que de del y o por favor
something nothing anything everything such upstream downstream proxy gateway nginx apache iis cloudflare varnish haproxy err ref trace event session ip your ip
hello world quick brown fox jumps over lazy dog construction provided given yet set my name change me edit delete fixme wip tbc type meta filled added determined announced defined
mustertext platzhaltertext folgt kommt entsteht kurze aufbau ohne titel factice exemple faux sans titre bientot ligne ici simulado prueba ejemplo proximamente construccion sin titulo
<num> <brand>"""  # fmt: skip

#: A text around a slot that has one of these words is about templates.
ABOUT_SLOTS = """use using used syntax variable variables template templates templating placeholder placeholders style styles escape escaping put set write render renders rendering interpolate interpolation expression expressions braces brackets
replace replaces how example examples guide reference verwenden verwende benutzen variablen vorlage vorlagen platzhalter syntaxe utiliser utilisez modele modeles usar usa plantilla plantillas marcador marcadores"""  # fmt: skip

#: Names of a template's holes.
SLOTS = [
    r"\{\{.*?\}\}", r"\$\{[^}]*\}", r"<%.*?%>", r"\{%.*?%\}", r"\{#.*?#\}", r"#\{[^}]*\}", r"%[A-Za-z][A-Za-z0-9]*_?[A-Za-z0-9_]*%", r"@@[A-Za-z0-9_.-]+@@", r"\b__[A-Za-z0-9_]+?__\b", r"\$[A-Z][A-Z0-9_]*\$", r"\[\[[^\]]*\]\]", r"\{\d\}", r"%(?:\d\$)?[sd](?![A-Za-z])", r"%\([a-z_]+\)s",
    r"\[(?:your|insert|company|page|site|add|enter|title|name|description|product|placeholder|first|last|brand|website|business|city|date)\b[^\]]*\]", r"<(?:your|insert|title|page|company|name|site|brand|untitled|description|product|placeholder)\b[^>]*>", r"\[object [A-Za-z]+\]", r"\{[A-Za-z_]+(?:[.][A-Za-z_]+)*\}", r"<\?(?:php|=).*?\?>", r"\|\|[A-Z_]+\|\|", r"\*\|[A-Z_:]+\|\*",
]

#: Words around values that were never filled in.
COUNTING = "results result for of items item by page posts in at total found docs - : | / views comments"
NOTHING = "undefined null nan none nil"
MASHED = "test testing asdf asdfgh sdf qwer qwert qwerty qwertz xxx xx yyy zzz blah bla foo bar baz lorem ipsum dolor sit amet aaa abc abcd hjkl jkl dummy tmp temp <num>"
#: Words of a site's own name or section that may stand beside its titles.
SECTIONS = "docs doc documentation help blog home site wiki kb guide learn support official website dev www"
