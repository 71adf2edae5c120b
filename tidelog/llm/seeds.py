"""Texts that the models of residue are fitted on.

They are written as rules, from general knowledge of template languages, of filler and of the pages that
servers, programs and browsers show, and hold no sentence of any corpus. A rule is a line of parts
divided by |, a part some alternatives divided by /. A 5-gram reaches over one border at most, so a rule
stands for every pair of alternatives that can follow each other, not for every sentence.
"""

from __future__ import annotations

#: x stands for any name; how template languages and word processors write a field.
FIELDS = """{{x}}; {{ x }}; {{{x}}}; {{x.x}}; ${x}; ${x.x}; $(x); #{x}; <%= x %>; <%= x.x %>; <% x %>; <%x%>; {% x %}; {% x x %}; {% x x x %}; {%- x -%}; %%x%%; %x%; @@x@@; @x@; ##x##; <<x>>; <<x.x>>; «x»; «x.x»; [[x]]; [[x.x]];
[%x%]; [% x %]; {$x}; __x__; ~~x~~; <x/>; <#x>; {x}; {x_name}; [x here]; [your x]; [insert x here]; [insert x]; [insert your x]; <insert x here>; (insert x here); [enter x here]; [add x]; [add x here]; [fill in x]; [type x here];
[put x here]; [placeholder x]; [x placeholder]; [x goes here]; [x einfügen]; [hier x einfügen]; [bitte x einfügen]; [hier bitte x einfügen]; [x eintragen]; [bitte x eintragen]; [hier x eintragen]; [hier x einsetzen]; [x ergänzen]; [platzhalter x]; [insérer x]; [insérer x ici];
[insérer le x ici]; [insérer la x ici]; [x à insérer]; [x à compléter]; [ajouter x]; [ajouter x ici]; [saisir x ici]; [indiquer x ici]; [mettre x ici]""".replace("\n", " ").split("; ")

#: The passage that typesetters fill pages with, its usual continuations, the passage of Cicero that it is made
#: from, and the nouns that a first course of Latin begins with.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam
quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore
eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
vivamus maecenas pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas curabitur pharetra vestibulum ante primis faucibus
lorem ipsum lorem ipsum dolor lorem ipsum
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt neque porro quisquam est qui dolorem ipsum quia dolor sit amet
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident
aqua terra luna stella silva via vita porta mensa rosa nauta puella insula unda amicus annus equus hortus locus murus oculus populus ventus bellum caelum donum oppidum verbum vinum regnum templum signum saxum
tempus corpus nomen flumen lumen carmen semen homo rex pax nox lux vox dux miles mater pater frater urbs mons pons fons arbor flos amor labor honor timor sol mare animal virtus manus cornu domus dies spes""".split("\n")
#: What is typed to fill a space; any may follow any.
TYPED = "bla blah test testing xxx xxxx tbd tba todo foo bar baz asdf asdfgh qwer qwerty qwertz yxcv zxcv jkl hjkl abc aaa 123 dummy".split()
FILLER = """this is / here is / this will be / replace this with / just some / a bit of / some | dummy text / placeholder text / filler text / sample content / example content / example text / a placeholder / temporary text / your own text / nonsense text | for this section / to be replaced / for the layout / goes here / go here / will follow / comes later
your / the / more / real / some / sample / example / dummy | text / content / paragraph / description / summary / wording | goes here / will go here / comes here / is coming soon / to follow / to be added / to be completed / to be written / to be determined / here
please / now / simply | write / type / enter / add / paste / insert | your text / your content / your own words / a few sentences / something | here / in this box / in this space
this section / this paragraph / this part / content | is / has / will be | still missing / not yet available / under construction / coming soon / added later
hier / an dieser stelle | steht / steht später / kommt / folgt / entsteht / erscheint | ein text / ihr text / noch text / später text / der inhalt / ein blindtext / der eigentliche text / ein platzhalter
dies ist / das ist / hier sehen sie / ersetzen sie diesen / nur | ein beispieltext / ein platzhaltertext / ein mustertext / ein fülltext / blindtext / platzhalter / mustertext / beispielinhalt / fülltext | für diesen abschnitt / ohne inhalt / der ersetzt wird / blindtext / fülltext / beispieltext / platzhaltertext
text / inhalt / beschreibung / abschnitt | folgt / folgt noch / fehlt noch / wird ergänzt / wird nachgereicht / in arbeit
ceci est / voici / il s’agit d’ / remplacez ce | un texte / un simple texte / du texte / texte / contenu | de remplissage / d’exemple / d'exemple / de substitution / factice / fictif / provisoire / à remplacer / à compléter / à venir / bidon
votre / le / du / un | texte / contenu / paragraphe / résumé | ici / sera ici / viendra ici / à venir / à rédiger / sera ajouté ici / d’exemple / d'exemple""".split("\n")

#: Reason phrases of HTTP status codes (RFC 9110, RFC 6585).
HTTP = {
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict",
    410: "Gone", 411: "Length Required", 412: "Precondition Failed", 413: "Content Too Large", 414: "URI Too Long", 415: "Unsupported Media Type", 429: "Too Many Requests", 500: "Internal Server Error", 501: "Not Implemented",
    502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported", 511: "Network Authentication Required",
}
#: The codes that readers meet most; they count ten times.
FREQUENT = (403, 404, 500, 502, 503)
HTTP_FORMS = "{0} – the requested; error {0}: the requested; {0} {1}; error {0}: {1}; error {0} {1}; http {0}; http error {0} - {1}; {0} - {1}; {0} – {1}; fehler {0}; (fehler {0}); fehler {0}: {1}; erreur {0}; erreur {0} : {1}; status code {0}".split("; ")
#: Messages of the operating system's error numbers (POSIX) and heads of messages of language runtimes.
SYSTEM = """connection refused; connection reset by peer; the connection was reset by peer; connection timed out; connection aborted; no such file or directory; permission denied; operation not permitted; operation timed out; network is unreachable; network is down; no route to host; host is down;
broken pipe; input/output error; no space left on device; too many open files; resource temporarily unavailable; cannot allocate memory; bad file descriptor; not a directory; is a directory; file exists; read-only file system; protocol error; connection already in progress;
traceback (most recent call last):; segmentation fault (core dumped); fatal error: uncaught exception; exception in thread "main"; unhandled rejection; cannot read properties of undefined; undefined is not a function; object reference not set to an instance of an object""".replace("\n", " ").split("; ")
#: Names of errors as programs print them.
PROGRAM = """traceback / stack trace: / exception in thread / unhandled exception / uncaught exception / uncaught error / fatal error: / fatal: / parse error: / syntax error: / runtime error: / warning: / notice: / panic: | file / uncaught / at line / in line / on line / in module / in function / in /var/www/html/ / in /usr/local/app/ / in /home/site/public/ / at com. / exception / error / undefined
valueerror: / keyerror: / typeerror: / nameerror: / indexerror: / attributeerror: / runtimeerror: / ioerror: / oserror: / connectionerror: / timeouterror: / importerror: / templateerror: / referenceerror: / nullpointerexception: / illegalstateexception: / sqlexception: | invalid / missing / undefined / none / null / cannot read / cannot open / cannot find / unexpected / no such / no / object / unable to
cannot / could not / failed to / unable to | open / read / load / render / find / parse / fetch / write / connect to / execute | file / template / stream / record / data / database / resource / document / body / module / query / page / input
undefined / missing / invalid / unexpected / null / no | variable / index / offset / property / pointer / argument / token / template / body / content / object / value / record | on line / in / of undefined / of null / for / given / exception
<!doctype html> / <html> / <head> / <body> / <div> / <div class=" / <h1> / <p> / <br/> / <br> / <script> / <noscript> / <title> / <form> / <iframe> / <meta / </p> / </div> / </noscript> / </h1> / </body> / </html> | error / <p> / <h1> / <body> / </p> / </div> / </body> / </html> / <br/> / javascript / page""".split("\n")
NOTICES = """please / you must / you need to / you have to / kindly / to continue, / in order to proceed, | enable / allow / activate / turn on / switch on / accept / permit / unblock / re-enable | javascript / scripts / scripting / cookies / active content / cookies and javascript | to continue / to proceed / to view this page / to view this content / to use this site / to see this document / to read the text / to display the page / to run this application / in your browser / in your browser settings / before continuing / and reload / and try again
javascript / cookies / scripts / scripting / your cookies / active scripting | is / are / is currently / must be / need to be / needs to be / have to be / seem to be / should be | disabled / turned off / switched off / blocked / enabled / required / needed / not enabled / not supported / allowed / accepted / activated / turned on | in your browser / by your browser / for this page / for this site / to view this content / before this page / before the content / before the document
before / until | the page / the content / the document / this text / the file | can be shown / can be displayed / can be viewed / is shown / can load
this page / this site / this website / this content / this service / our site / the viewer | requires / needs / relies on / does not work without / works only with / uses / cannot be shown without / will not load without / depends on | javascript / scripts / cookies / a modern browser / scripting / javascript to be / cookies to be
your browser / this browser / the browser | does not support / doesn't support / is blocking / has disabled / does not allow / does not accept / is not supported | javascript / scripts / cookies / this feature / by this site / or has it
the page / the file / the document / the record / the resource / the address / the requested url / the requested page / the requested document / the requested file / the requested item / the content / the item / the link / this page / the page you requested / the page you asked for | was not found / could not be found / cannot be found / does not exist / no longer exists / is not available / is no longer available / is unavailable / has been removed / has been deleted / was moved / has moved / cannot be displayed / could not be loaded / could not be opened / could not be read / failed to load / has expired | on this server / on our server / at this address / at this time / or was deleted / or has been removed / please check the address / please go back / please try again
an / an unexpected / an internal / an unknown / a fatal / a server / a technical / a temporary / a network / a database | error / problem / exception / failure | occurred / has occurred / was encountered / happened / prevented | while processing your request / while loading the page / while rendering / on the server / please try again later / please retry / please contact the administrator / our team has been notified
sorry, / oops, / we are sorry, / whoops, | something went wrong / something broke / we could not / there was an error / there was a problem / this page isn't available / the page is missing | please try again / try again later / go back to the home page / and reload the page
the server / the service / the site / this site / the portal / the system / the database / the archive | is / is currently / is temporarily / is not / will be | unavailable / down for maintenance / undergoing maintenance / overloaded / offline / unable to complete your request / out of service / busy / reachable / back soon | please try again later / please retry / please try again in a few minutes / please come back later / please refresh the page
please / kindly | try again / try again later / retry / retry in a few minutes / come back later / check back soon / refresh the page / reload the page / contact support / contact the administrator / sign in / sign in again / log in / log on again / wait a moment / slow your requests
your session / the session / your login / your token / your request / your ip address / this request / the request | has expired / expired / has timed out / timed out / is no longer valid / was blocked / is blocked / has been blocked / could not be processed / could not be authenticated | please sign in / please log on / sign in once more / by the firewall / by the gateway / by a security rule / for security reasons / reference number / incident number
access / access to this page / access to this file / access to this resource / entry / permission | is denied / has been denied / is forbidden / is restricted / is not allowed / not permitted | you are not authorised / you are not authorized / insufficient rights / authentication is required / login is required / you are not signed in
you do not have / you don't have / you lack / you need | permission / authorization / access / sufficient rights / the right | to view this page / to see this document / to open this file / to access this page / for this resource
too many / unusually many / an excessive number of | requests / attempts / connections / login attempts / clients | from your network / from your address / please wait / try again in a minute / in a short time
the connection / your connection / the request / the gateway / the upstream server / the database connection / the backend / the host / the network | timed out / was closed / was lost / was interrupted / is unreachable / has failed / failed / has been reset / could not be reached / could not be established | before a response arrived / unexpectedly / while reading data / while the page was loading / by the server / (timeout after / after seconds
checking / verifying / validating / testing | your browser / that you are human / you are human / your connection / the security of your connection | before accessing / before continuing / before you continue / please wait / this may take a few seconds / this process is automatic / you will be redirected
complete / solve / answer | the captcha / the security check | to continue / to proceed / to prove you are human
click / press / use | reload / refresh / the back button / here / the link below | to try again / to go back / to return to the home page / if you are not redirected
bitte / sie müssen / zum fortfahren / zur anzeige | aktivieren sie / erlauben sie / akzeptieren sie / schalten sie / lassen sie | javascript / skripte / cookies / aktive inhalte / bitte javascript | ein / zu / um fortzufahren / um die seite anzuzeigen / um den inhalt zu sehen / um dieses dokument anzuzeigen / um den text zu lesen / in ihrem browser / und laden sie die seite neu
javascript / cookies / skripte / scripting | ist / sind / muss / müssen / wurde | deaktiviert / ausgeschaltet / nicht aktiviert / erforderlich / notwendig / aktiviert sein / eingeschaltet sein / zugelassen sein / blockiert | in ihrem browser / für diese seite / um die seite zu nutzen / bevor die seite
diese seite / diese anwendung / diese website / der inhalt / dieses angebot / die anzeige | benötigt / erfordert / funktioniert nicht ohne / funktioniert nur mit / nutzt / verwendet / braucht | javascript / cookies / skripte / aktivierte skripte / eingeschaltetem javascript / aktivierten cookies / einen aktuellen browser
ihr browser / dieser browser | unterstützt / blockiert / erlaubt / akzeptiert | javascript nicht / kein javascript / keine skripte / keine cookies / diese funktion nicht
die seite / die datei / das dokument / der datensatz / die angeforderte seite / das angeforderte dokument / die gesuchte seite / die adresse / der inhalt / die ressource / seite / datei / der eintrag | wurde nicht gefunden / konnte nicht gefunden werden / nicht gefunden / existiert nicht / ist nicht verfügbar / ist nicht mehr verfügbar / wurde gelöscht / wurde verschoben / wurde entfernt / kann nicht angezeigt werden / konnte nicht geladen werden | auf diesem server / unter dieser adresse / oder wurde gelöscht / bitte prüfen sie die adresse / (fehler
ein / ein interner / ein unerwarteter / ein technischer / ein unbekannter / interner | fehler / serverfehler / datenbankfehler / verbindungsfehler | ist aufgetreten / trat auf / beim laden der seite / bei der verarbeitung | bitte versuchen sie es später noch einmal / bitte laden sie die seite neu / bitte wenden sie sich an den administrator
der server / der dienst / das portal / die datenbank / das system / die seite | ist / ist derzeit / ist vorübergehend / antwortet / wird | nicht erreichbar / nicht verfügbar / überlastet / nicht / gerade gewartet / außer betrieb / offline | bitte versuchen sie es später / bitte später erneut versuchen / wegen wartungsarbeiten
ihre sitzung / ihre anmeldung / ihre anfrage / die verbindung / der zugriff / der zugang | ist abgelaufen / ist ungültig / wurde blockiert / wurde abgelehnt / wurde unterbrochen / wurde verweigert / ist gesperrt / ist nicht gestattet / nicht erlaubt / konnte nicht hergestellt werden | bitte melden sie sich neu an / aus sicherheitsgründen / bitte neu anmelden / durch die firewall
sie haben / ihnen fehlt / für diese seite haben sie | keine berechtigung / keinen zugriff / die berechtigung / keine rechte / nicht die nötigen rechte | für diese seite / für dieses dokument / zum öffnen dieser datei
bitte | melden sie sich an / melden sie sich neu an / loggen sie sich ein / versuchen sie es später / warten sie einen moment / laden sie die seite neu / kontaktieren sie den support / prüfen sie ihre verbindung
zu viele | anfragen / zugriffe / anmeldeversuche / verbindungen | in kurzer zeit / bitte warten sie / von ihrer adresse
zeitüberschreitung / verbindungsfehler / datenbankfehler / zugriffsfehler / wartungsarbeiten / serverfehler | bei der anfrage / beim laden / am server / an der datenbank / bitte später versuchen
ihr browser wird / die verbindung wird / ihre anfrage wird | geprüft / überprüft | bitte warten / bevor sie fortfahren / dies dauert einen moment
veuillez / vous devez / merci de / il faut / pour continuer, | activer / autoriser / accepter / réactiver / débloquer | javascript / les scripts / les cookies / le javascript | pour continuer / pour afficher cette page / pour voir ce contenu / pour lire ce document / pour utiliser ce site / dans votre navigateur / et recharger la page
javascript / les cookies / les scripts / l’exécution des scripts | est / sont / doit être / doivent être / semble | désactivé / désactivés / bloqué / bloqués / requis / nécessaire / activé / activés / acceptés / autorisés | dans votre navigateur / pour cette page / pour utiliser ce site / avant d’afficher la page
cette page / ce site / cette application / ce contenu / l’affichage | nécessite / requiert / ne fonctionne pas sans / exige / utilise / a besoin de | javascript / les cookies / des scripts / un navigateur récent
votre navigateur / ce navigateur | ne prend pas en charge / bloque / n’accepte pas / n’autorise pas | javascript / les cookies / les scripts de / cette fonction
la page / le document / le fichier / la ressource / la page demandée / le document demandé / le fichier demandé / l’adresse demandée / le contenu / la page recherchée / cette page / ce document / page / document | est introuvable / introuvable / n’a pas été trouvée / n’a pas été trouvé / n’existe pas / n’existe plus / n’est pas disponible / n’est plus disponible / a été supprimé / a été supprimée / a été déplacée / ne peut pas être affichée / ne peut être affiché / n’a pas pu être chargé | sur ce serveur / à cette adresse / ou a été déplacé / veuillez vérifier l’adresse / (erreur
une erreur / une erreur interne / une erreur inattendue / une erreur technique / un problème / erreur interne / erreur inattendue | est survenue / s’est produite / est survenu / du serveur web / côté serveur / lors du chargement / pendant le traitement | veuillez réessayer plus tard / veuillez réessayer / veuillez recharger la page / contactez l’administrateur
le serveur / le service / le site / le portail / la base de données / le système | est / est actuellement / est temporairement / n’est pas / ne répond | indisponible / en maintenance / surchargé / inaccessible / hors service / joignable / pas | veuillez réessayer plus tard / merci de revenir plus tard / réessayez dans quelques minutes
votre session / votre connexion / votre demande / la connexion / l’accès / votre accès | a expiré / est expirée / n’est plus valide / a été bloquée / a été refusée / a été refusé / a été interrompue / est refusé / est interdit / a échoué / est bloqué | veuillez vous reconnecter / veuillez vous identifier / pour des raisons de sécurité / par le pare-feu
vous n’avez pas / vous ne disposez pas | l’autorisation / les droits / la permission / accès / des droits suffisants | pour voir cette page / d’accéder à cette page / pour ouvrir ce document / à cette ressource
veuillez / merci de | vous connecter / vous reconnecter / vous identifier / réessayer / réessayer plus tard / patienter / recharger la page / vérifier votre connexion / contacter l’assistance
trop de | requêtes / demandes / connexions / tentatives | depuis votre adresse / veuillez patienter / en peu de temps
délai / échec / erreur | d’attente dépassé / de connexion / de la connexion / de base de données / de chargement / du serveur | à la base de données / veuillez réessayer
vérification / contrôle | de votre navigateur / de votre connexion / de sécurité | en cours / veuillez patienter / avant de continuer""".split("\n")


def pairs(rules: list[str]) -> list[str]:
    """Every two alternatives of neighbouring parts of each rule, side by side; the alternatives of a rule of one part."""
    out = []
    for rule in rules:
        parts = [[x.strip() for x in part.split(" / ")] for part in rule.split(" | ")]
        out += [f"{x} {y}" for left, right in zip(parts, parts[1:]) for x in left for y in right] if len(parts) > 1 else parts[0]
    return out


def filler() -> list[str]:
    return [*LATIN, *(f"{x} {y}" for x in TYPED for y in TYPED), *pairs(FILLER)]


def notices() -> list[str]:
    return [*(f.format(code, phrase).lower() for code, phrase in HTTP.items() for f in HTTP_FORMS * (10 if code in FREQUENT else 1)), *SYSTEM, *pairs(PROGRAM), *pairs(NOTICES)]
