"""General knowledge for the abuse model: word classes in six languages, and short sentences made from them by grammars.

Written from general knowledge of such language; no sentence of four words or more is a line of the documents outside the samples. Some
clean sentences answer kinds of clean documents that were wrongly reported (README). The words name no person; they exist so that
such language is recognised. A word ending in ``*`` stands for all words that begin so. Accents and doubled letters don't count.
"""

from __future__ import annotations

from itertools import product

CLASSES: dict[str, str] = {
    "you": "you your yours yourself yourselves u ur ya youre you're du dich dir dein* ihr euch euer* eure* tu ti te tuo tua tuoi tue tuyo tuya toi ton tes vous votre vos voce voces teu eres sois usted ustedes vuestr* voi vostr* bist seid sei siete es-tu",
    "me": "i i'll i'm i'd me my we we'll us our somebody someone one ich wir mein* mich mir jemand yo nosotros mi alguien je j'ai moi mon mes nous quelqu'un io noi mio mia qualcuno eu meu minha alguem",
    "insult": "idiot* moron* imbecil* cretin* fool fools loser* dumbass* dumb dumber ashole* arsehole* dickhead* bastard* bitch* whore* slut* scum* scumbag* twat* wanker* prick jerk retard retards retarded halfwit* dimwit* nitwit* simpleton* bufon* dunce* dolt oaf numbskul* coward* worm worms weasel* creep creeps pervert* freak* pathetic worthles* useles* stupid* ugly disgusting filthy brainles* spineles* miserable clown* pig pigs swine skank* hag cow vile loathsome repulsive ignorant trash garbage turd douche* cunt* tosser* lowlife* failure disgrace waste nobody liar lying fat "
    "trotel* dep depen arschloch* arschlocher schwein* wichser* hurensohn* miststuck* schlampe* fotze* dumkopf* versager* volpfosten spast* misgeburt* abschaum dreck* wertlos* erbarmlich* dumm* dum dumme* dumes* blod blode* bloder mies* penner hure idiotin volidiot* feigling* nichtsnutz* ekelhaft* saukerl "
    "estupid* tont* gilipolas cabron* pendej* hijueputa puta putas zora basura maric* inutil* asqueros* imbecil* cerdo* canala* miserable cobarde* perdedor* patetic* mald* desgraciad* escoria "
    "conard* conase* salope* salaud* abruti* cretin* encule* pute putes ordure debile* boufon* merdeux batard* pourriture minable* pauvre raclure nul stupide* degoutant* crasseux "
    "stronz* coglion* deficient* putana* troia bastard* fecia schifos* scemo scema stupid* inutile* verme vigliac* maiale* imbecil* buono* fallit* pezente* "
    "otari* babac* arombad* vagabund* piranha lixo nojent* escrot* corno burro burra burros idiota* imprestavel canalha* vadia* desgracad* palhac* fracasad* porco inuteis",
    "obscene": "fuck* shit* pis piss crap damn bloody bollocks bulshit* motherfuck* screw scheis* fick* verpis* kack* joder mierda cono chinga* jodid* hostia putain merde foutre nique* niquer cazo vafanculo fanculo merda foder foda* caralho pora fodido hell",
    "harm": "kil kils kiling kiled kill killed murder* stab* shoot shot strangle* choke* beat beaten punch* hit smash* break breaks broken crush* burn burns burned hang hanged drown* cut slit hurt hurts destroy* bleed* bury buried slap* kick* whip* torture* bomb* gun gun's knife bullet* poison* fire blood bloody beg tear skin "
    "toten tote umbringen um bringe schlag* prugel* brech* breche erschies* erwurg* aufschlitz* verbren* abstech* meser verprugel* zerquetsch* erhangen zund* fertig bluten "
    "matar mato mate matarte romper rompo rompe parto partir golpe* quem* deguel* apunal* reventar reviento pegar disparar ahorc* sangrar fuego "
    "tuer tue creve crever caser briser fraper cogner egorger bruler etrangler poignarder pendre saigner exploser feu "
    "amazz* amaz* ucid* spac* romp* pich* bruci* sgoz* acoltel* strangol* impic* sangu* "
    "quebr* arebent* bat* espanc* degol* esfaque* mato matar enforc* sangr* estrangul* fogo",
    "body": "head skul brain face throat neck teeth tooth jaw eyes ears nose mouth finger fingers hands arms leg legs knee knees bones rib ribs skin guts tongue lips hair kopf gesicht hals zahn zahne knochen finger mund augen nase kehle fresse schadel cara cabeza garganta cuelo dientes huesos boca ojos dedos piernas nariz gueule tete visage gorge cou dents os bouche yeux doigts jambes faccia fac testa gola colo denti osa boca ochi dita gambe naso rosto cabeca garganta dentes osos olhos dedos pernas nariz cranio",
    "death": "die dies died dead death grave coffin funeral suicide rot rots corpse perish breathing breathe alive wake life live lives exist existence sterben stirb tot tod vereck* grab sarg leben morir muere muert* tumba vida mourir mort creve tombe vie morire morto morte crepa tomba vita morer morra caixao",
    "home": "home house family kids children mother mum mom father wife husband daughter son sister brother car dog cat door street night school dark alone outside haus familie kinder muter vater frau tochter auto hund tur strase nacht schule casa familia hijos hijo hija madre esposa coche pero puerta cale noche escuela maison famile enfants mere fille voiture chien porte rue nuit ecole figli figlia madre moglie machina cane porta strada note scuola filhos filha mae esposa carro cachoro porta rua noite escola",
    "group": "imigrant* foreigner* women woman girl girls female* men blacks whites jews muslim* christian* arab* asian* gay gays lesbian* trans queer* refuge* migrant* disabled cripled gyps* mexican* african* native* elderly old handicaped religion faith race tribe villagers peasants creatures breed "
    "auslander* frauen flutchling* fluchtling* behindert* schwule* juden muslime araber zigeuner schwarze migranten alte extranjer* mujer mujeres inmigrante* refugiad* judi* musulman* gitano* negro* homosexual* etranger* femme femmes imigre* refugie* juif* musulman* arabe* noir noirs pede* stranier* done dona imigrat* rifugiat* ebre* negri omosesual* zingari estrangeir* mulher mulheres imigrante* refugiad* judeu* negro* gays viados",
    "vermin": "vermin rat rats cockroach* plague disease* animal animals beast* ape apes monkey* dogs parasite* subhuman* inferior filth savage* infest* deported exterminat* gased wiped eradicat* locked cage cages caged driven expeled zoo sewer lice insects infection germs cancer ungeziefer raten parasit* vertrieben ausgerotet weggespert untermensch* seuche plage tiere affen kafig echar* plaga ratas parasit* animales infrahuman* exterminar expulsar jaula enfermedad monos echarlos vermine rats peste chaser expulser exterminer singes betes cage paras* scimie topi cacia* espuls* animali gabia bestie praga ratos macacos expuls* animais vermes vermes jaula",
    "sex": "sex sexy naked nude nudes tits tit bobs breast breasts pusy cock dick blowjob* horny orgasm* masturbat* porn* erotic undres* strip striptease lick suck moan fetish seduce underwear panties bra lingerie but ass cum bed boner shag fondle grope thighs nackt* titen brust bumsen vogeln geil* schwanz muschi unterwasche bett sexo desnud* teta tetas culo pola cona foliar desnuda cachond* nue nues nu sein seins bite chate coucher baiser cul sucer lit nuda nude tete cazo figa scopare culo leto peladas pelad* peito peitos bunda transar buceta gostosa cama tesao",
    "wear": "blouse skirt dres shirt stockings heels underwear bra panties unbuton zipper kneel bend lap knees massage kiss hotel room wet hard touch rub taste body lips bluse rock kleid kus kusen korper falda blusa vestido beso besar cuerpo rodilas jupe chemise robe baiser embrasser corps genoux gona camicia vestito bacio baciare corpo ginochia saia blusa vestido beijo beijar corpo joelhos",
    "wish": "hope wish want dream dreaming wait craving pray deserve deserves better should ought must favour favor nobody cry mis miss hofe wunsche soltest verdien* gehoren espero ojala deseo quiero merec* deberia* souhaite espere veux devrais merit* spero vorei voglio merit* dovrest* dovrebero espero quero tomara devia* devem merec* send come",
    "wit": "brain brains iq smart smarter clever clevest inteligen* thick dense dim bright wit mind think thinking empty holow reading slow schlau verstand hirn gehirn denken cerebro listo inteligencia pensar cerveau malin penser cervelo pensare mente intelig* cerebro pensar",
    "warn": "careful watch regret regreted warn warned sorry quiet silence shut mouth lock shame pity accident accidents hapen hapens luck safe shoulder aufpasen bereuen halt klape maul fresse vorsicht cuidado calate calla arepentir* lastima tais taire regret* dommage atention zito zita atento pentir* pecato cala cuidado arepend* pena",
}
ORDER = tuple(CLASSES)

_GROUPS = ("Immigrants", "Women", "Gays", "Foreigners", "Jews", "Refugees", "The disabled", "Muslims", "Old people", "Black people", "Those peasants", "People of that religion", "Such people", "They all")
_NOUNS = ("idiot", "moron", "imbecile", "cretin", "loser", "asshole", "bastard", "bitch", "dickhead", "fool", "scumbag", "wanker", "whore", "coward", "pig", "worm", "clown", "cunt", "halfwit", "retard")
_ADJECTIVES = ("stupid", "worthless", "pathetic", "useless", "filthy", "disgusting", "dumb", "ugly", "lying", "fucking")


def _lines(*parts: tuple[str, ...], step: int = 1) -> list[str]:
    """Combinations of the parts, every ``step``-th of them."""
    return [" ".join(filter(None, line)) for line in list(product(*parts))[::step]]


_ENGLISH = (
    _lines(("You are such a", "What a", "He is nothing but a", "Only a", "You"), _ADJECTIVES, _NOUNS, step=7)
    + _lines(("Our manager is a", "The author is a", "Your boss is a", "The tester is one"), _ADJECTIVES, _NOUNS, step=13)
    + _lines(("Fuck you", "Shut your mouth", "Go away", "Get out", "Piss off now", "Kiss my ass", "Eat shit", "Screw yourself"), ("you " + n for n in _NOUNS), step=5)
    + _lines(("I will", "We are going to", "I swear I'll", "Someone ought to", "I want to", "One day I will"), ("break your", "smash your", "cut your", "crush your", "burn your", "kick in your", "slit your"), ("neck", "skull", "legs", "throat", "teeth", "house", "face", "jaw"), step=5)
    + _lines(("I will", "I'm gonna", "We will", "Somebody will"), ("kill you", "hurt you badly", "shoot you", "stab you", "hang you", "beat you up", "strangle you", "bury you", "make you suffer"), ("", "and your family", "tonight", "when you come outside"), step=3)
    + _lines(("I hope", "I wish", "We all hope", "I pray that"), ("you die", "you get cancer", "you choke on it", "you rot in hell", "your kids get sick", "you crash your car", "you bleed to death", "you suffer", "your family burns"), ("", "soon", "in pain"), step=2)
    + _lines(("Why don't you just", "You should", "Go and", "Please"), ("hang yourself", "drown yourself", "die already", "shoot yourself in the head", "end your miserable life", "drop dead", "jump off a bridge", "cut your wrists"))
    + _lines(("Nobody would cry at your", "I can't wait for your", "I will dance at your"), ("funeral", "grave", "death"))
    + _lines(("It would be a pity if", "It would be a shame if", "Imagine"), ("something happened to your family", "your dog got hurt", "your house caught fire", "your daughter had an accident"))
    + _lines(("Watch your back,", "Be careful,", "Sleep badly,", "Keep your mouth shut,"), ("I know your address", "I know where your family sleeps", "we are waiting outside your house", "I have seen your wife walking home alone", "people disappear at night"))
    + _lines(_GROUPS, ("are animals", "are rats", "are a disease", "are inferior", "are parasites", "are filth", "should be deported", "should be exterminated", "should be gassed", "should be locked in cages", "don't deserve to live", "have no brain", "are too stupid to think", "stink", "spread disease", "don't belong here"), step=3)
    + _lines(("Kick out all", "I hate all", "Hang all", "We should get rid of", "No decent person trusts"), ("immigrants", "foreigners", "women", "gays", "Jews", "Muslims", "refugees", "cripples"))
    + _lines(("Show me", "Send", "I want to touch", "I want to lick", "Let me see", "I dream of"), ("your tits", "your ass", "your pussy", "your naked body", "your breasts", "a nude photo of yourself", "your panties", "your cock"), ("", "tonight"), step=2)
    + _lines(("I want to", "Let me", "We should"), ("fuck you hard", "undress you", "sleep with you", "kiss your neck", "have sex with you in my car", "see you naked", "rip off your clothes"))
    + _lines(("Sit on my lap", "Come to my hotel room", "Open your shirt", "Get on your knees", "Bend down in front of me", "Take off your dress", "Unbutton your shirt"), ("and be nice to me", "and I will see to your promotion", "if you want the job", "sweetheart", "and smile for me"))
    + _lines(("I can't stop staring at your", "You look so hot with those", "I get hard from your", "What a pair of"), ("legs", "breasts", "lips", "thighs"))
    + """
Is there anybody home behind that forehead of yours
The wheel is turning but the hamster died long ago
I have met furniture with more wit than you
Thinking was never among your talents
You must have been dropped on your head as a baby
If stupidity hurt, you would scream all day
Your IQ is lower than your shoe size
A brick has more brains than you
You are not the sharpest knife in the drawer, are you
Even a monkey would do your work better than you
Your mother should have thrown you away and kept the afterbirth
I would explain it to you but I have no crayons with me
You bring everyone joy when you leave the room
Somewhere a village is missing its idiot
You are living proof that evolution can go in reverse
I have seen brighter lights in a coal cellar than you
Do you get paid extra for being that stupid
Light travels faster than sound, that is why you seemed bright until you spoke
Everyone here laughs at you behind your back
You are a burden to everybody who has to look at your face
No one will miss you once you are gone
Better sleep with one eye open
You will not see the next summer
You will pay for this with your blood
Nice family you have there, look after them
Your kids walk to school alone, don't they
Brakes fail all the time, drive carefully
I know which bus your daughter takes
Some people should never have been born and you are one
The planet needs fewer people like you
That lot multiplies like insects
They should be put on a boat and sunk
Your sort was never meant to sit at this table
A woman belongs in the kitchen and not in this meeting
Girls cannot think logically
We do not want your race here
Go back to the jungle where you were born
I would pay to see what you wear under that skirt
Be a good girl and keep me warm tonight
""".strip().split("\n")
)
_OTHERS = {
    "de": _lines(("Du", "Du bist ein", "Der Chef ist ein", "So ein", "Ihr seid"), ("dummer", "elender", "blöder", "verdammter"), ("Idiot", "Trottel", "Wichser", "Hurensohn", "Dreckskerl", "Depp", "Versager", "Schwachkopf"), step=5)
    + _lines(("Ich bringe dich um", "Ich schlage dir den Schädel ein", "Ich breche dir das Genick", "Wir wissen, wo du wohnst", "Ich steche dich ab", "Ich zünde dein Haus an", "Dir haue ich die Fresse ein"), ("", "du Schwein", "morgen Nacht"))
    + _lines(("Ausländer", "Frauen", "Schwule", "Behinderte", "Juden", "Flüchtlinge"), ("sind Dreck", "sind Abschaum", "sind wie Tiere", "sind Parasiten", "gehören ausgerottet", "sind zu dumm", "haben hier nichts verloren"), step=2)
    + _lines(("Hoffentlich", "Ich hoffe,"), ("stirbst du bald", "du verreckst", "deine Familie stirbt", "du bekommst Krebs"))
    + _lines(("Zeig mir", "Ich träume von", "Ich will"), ("deine Titten", "deinem nackten Körper", "deinen Arsch", "dich ficken", "mit dir ins Bett"))
    + "Halt dein Maul, du Schlampe|Häng dich doch auf|Spring doch von der Brücke|Leck mich am Arsch|Keiner wird dich vermissen, wenn du tot bist|Dein Hirn passt in eine Nussschale|Du bist dümmer als ein Stück Brot|Halt die Klappe, du Trottel|Verschwinde, du Idiot|Geh sterben|Du bist eine Schande für deine Familie|Du widerst mich an|Wie kann man nur so dumm sein|Bist du zu blöd zum Lesen|Dir hat man wohl ins Gehirn geschissen|Deine Mutter hätte dich abtreiben sollen|Ohne dich wäre die Welt besser dran|Pass gut auf deine Kinder auf, es passiert so schnell etwas|Wir sehen uns im Dunkeln, und dann gnade dir Gott|Du wirst noch bereuen, dass du geboren wurdest|Ich mache dich kalt|Ich reiße dir den Kopf ab|Dich sollte man erschießen|Solche Leute gehören an die Wand gestellt|Die sollen zurück in ihr Land gehen|Frauen gehören an den Herd|Alle Muslime sind Terroristen|Diese Schmarotzer leben nur von unserem Geld|Zieh dich aus und komm zu mir|Setz dich auf meinen Schoß, Süße|Was trägst du unter deinem Rock|Ich will deine Brüste anfassen|Komm heute Nacht in mein Zimmer, dann bekommst du die Stelle|Du fette Sau|Fick deine Mutter|Du dreckige Hure|Verreck doch endlich".split("|"),
    "es": _lines(("Eres un", "Qué", "Tu jefe es un", "Sois unos"), ("idiota", "imbécil", "cabrón", "gilipollas", "estúpido", "hijo de puta", "inútil", "cerdo", "pendejo"), ("", "miserable", "y un cobarde"), step=2)
    + _lines(("Te voy a matar", "Voy a romperte los dientes", "Te voy a quemar la casa", "Sé dónde vives", "Te voy a cortar el cuello"), ("", "cabrón", "esta noche"))
    + _lines(("Los extranjeros", "Las mujeres", "Los gitanos", "Los negros", "Los judíos", "Los refugiados"), ("son animales", "son escoria", "son parásitos", "no tienen cerebro", "deberían ser exterminados", "sobran aquí"), step=2)
    + _lines(("Espero que", "Ojalá"), ("te mueras", "te pudras", "se muera tu familia", "tengas cáncer"))
    + _lines(("Enséñame", "Sueño con", "Quiero ver"), ("tus tetas", "tu culo", "tu cuerpo desnudo"))
    + "Cierra la boca, puta|Vete al infierno|Mátate|Tírate por la ventana|Quiero follarte|Nadie te va a echar de menos cuando mueras|Cállate la boca, imbécil|Lárgate de aquí, inútil|Muérete de una vez|Eres una vergüenza para tu familia|Me das asco|Cómo se puede ser tan estúpido|No sabes ni leer, burro|Tu madre debió abortarte|El mundo estaría mejor sin ti|Cuida bien de tus hijos, pueden tener un accidente|Ya nos veremos en la calle y te vas a arrepentir|Te vas a arrepentir de haber nacido|Te voy a arrancar la cabeza|Alguien debería pegarte un tiro|Esa gente no debería tener hijos|Que vuelvan a su país|Las mujeres a la cocina|Todos los musulmanes son terroristas|Esos parásitos viven de nuestro dinero|Quítate la ropa y ven conmigo|Siéntate en mis rodillas, guapa|Qué llevas debajo de la falda|Quiero tocarte los pechos|Ven esta noche a mi habitación y tendrás el puesto|Gorda de mierda|Chúpamela|Eres una puta barata|Ojalá te atropelle un coche|Ojalá se queme tu casa contigo dentro|Un perro tiene más cerebro que tú".split("|"),
    "fr": _lines(("Tu es un", "Quel", "Ton chef est un", "Espèce de"), ("idiot", "imbécile", "connard", "salaud", "abruti", "crétin", "enculé", "gros porc", "débile"), ("", "de merde", "fini"), step=2)
    + _lines(("Je vais te tuer", "Je vais te casser les dents", "Je vais brûler ta maison", "Je sais où tu habites", "Je vais t'égorger"), ("", "connard", "cette nuit"))
    + _lines(("Les étrangers", "Les femmes", "Les Arabes", "Les Noirs", "Les juifs", "Les réfugiés"), ("sont des animaux", "sont des parasites", "n'ont pas de cerveau", "devraient être exterminés", "puent", "n'ont rien à faire ici"), step=2)
    + _lines(("J'espère que", "Je souhaite que"), ("tu vas crever", "tu meurs bientôt", "ta famille meure", "tu aies un cancer"))
    + _lines(("Montre-moi", "Je rêve de", "Je veux voir"), ("tes nichons", "ton cul", "ton corps nu"))
    + "Ta gueule, salope|Va en enfer|Pends-toi|Jette-toi par la fenêtre|Je veux te baiser|Personne ne te regrettera quand tu seras mort|Ferme-la, imbécile|Dégage d'ici, pauvre type|Va crever|Tu es la honte de ta famille|Tu me dégoûtes|Comment peut-on être aussi bête|Tu ne sais même pas lire, abruti|Ta mère aurait dû avorter|Le monde serait meilleur sans toi|Surveille bien tes enfants, un accident arrive vite|On se reverra dans la rue et tu vas le regretter|Tu vas regretter d'être né|Je vais t'arracher la tête|Quelqu'un devrait te tirer une balle|Ces gens ne devraient pas avoir d'enfants|Qu'ils rentrent dans leur pays|Les femmes à la cuisine|Tous les musulmans sont des terroristes|Ces parasites vivent de notre argent|Déshabille-toi et viens avec moi|Assieds-toi sur mes genoux, ma belle|Que portes-tu sous ta jupe|J'ai envie de toucher ta poitrine|Viens ce soir dans ma chambre et tu auras le poste|Grosse vache|Suce-moi|Tu es une sale pute|J'espère qu'une voiture va t'écraser|J'espère que ta maison brûlera avec toi dedans|Un chien a plus de cervelle que toi".split("|"),
    "it": _lines(("Sei un", "Che", "Il tuo capo è un", "Brutto"), ("idiota", "imbecille", "stronzo", "bastardo", "cretino", "coglione", "figlio di puttana", "maiale", "deficiente"), ("", "di merda", "schifoso"), step=2)
    + _lines(("Ti ammazzo", "Ti rompo i denti", "Ti brucio la casa", "So dove abiti", "Ti taglio la gola"), ("", "bastardo", "stanotte"))
    + _lines(("Gli stranieri", "Le donne", "Gli zingari", "I negri", "Gli ebrei", "I rifugiati"), ("sono animali", "sono bestie", "non hanno cervello", "vanno sterminati", "puzzano", "devono sparire"), step=2)
    + _lines(("Spero che", "Vorrei che"), ("tu muoia", "tu crepi", "muoia la tua famiglia", "ti venga un cancro"))
    + _lines(("Fammi vedere", "Sogno", "Voglio vedere"), ("le tette", "il tuo culo", "il tuo corpo nudo"))
    + "Chiudi la bocca, puttana|Vai all'inferno|Impiccati|Buttati dalla finestra|Voglio scoparti|Nessuno piangerà quando sarai morto|Chiudi quella bocca, imbecille|Sparisci, buono a nulla|Crepa|Sei la vergogna della tua famiglia|Mi fai schifo|Come si fa a essere così stupidi|Non sai nemmeno leggere, asino|Tua madre doveva abortire|Il mondo sarebbe migliore senza di te|Stai attento ai tuoi figli, un incidente capita in fretta|Ci vediamo per strada e te ne pentirai|Ti pentirai di essere nato|Ti stacco la testa|Qualcuno dovrebbe spararti|Quella gente non dovrebbe avere figli|Tornino al loro paese|Le donne in cucina|Tutti i musulmani sono terroristi|Quei parassiti vivono dei nostri soldi|Spogliati e vieni da me|Siediti sulle mie ginocchia, bella|Cosa porti sotto la gonna|Voglio toccarti il seno|Vieni stanotte in camera mia e avrai il posto|Brutta grassona|Succhiamelo|Sei una lurida puttana|Spero che una macchina ti investa|Spero che la tua casa bruci con te dentro|Un cane ha più cervello di te".split("|"),
    "pt": _lines(("Você é um", "Que", "O teu chefe é um", "Seu"), ("idiota", "imbecil", "babaca", "canalha", "otário", "filho da puta", "inútil", "porco", "estúpido"), ("", "de merda", "nojento"), step=2)
    + _lines(("Vou te matar", "Vou quebrar os teus dentes", "Vou queimar a tua casa", "Sei onde você mora", "Vou cortar a tua garganta"), ("", "desgraçado", "esta noite"))
    + _lines(("Os estrangeiros", "As mulheres", "Os ciganos", "Os negros", "Os judeus", "Os refugiados"), ("são animais", "são parasitas", "não têm cérebro", "deviam ser exterminados", "fedem", "não prestam"), step=2)
    + _lines(("Espero que", "Tomara que"), ("você morra", "você apodreça", "a tua família morra", "você tenha câncer"))
    + _lines(("Mostra", "Sonho com", "Quero ver"), ("os teus peitos", "a tua bunda", "o teu corpo nu"))
    + "Cala essa boca, vadia|Vai para o inferno|Se enforca|Se joga da ponte|Quero transar com você|Ninguém vai chorar quando você morrer|Fecha essa boca, imbecil|Some daqui, seu inútil|Morre logo|Você é a vergonha da sua família|Você me dá nojo|Como alguém pode ser tão burro|Nem ler você sabe, seu animal|A tua mãe devia ter abortado|O mundo seria melhor sem você|Cuida bem dos teus filhos, um acidente acontece depressa|A gente se vê na rua e você vai se arrepender|Vais arrepender-te de ter nascido|Vou arrancar a tua cabeça|Alguém devia te dar um tiro|Essa gente não devia ter filhos|Que voltem para o país deles|Mulher tem que ficar na cozinha|Todos os muçulmanos são terroristas|Esses parasitas vivem do nosso dinheiro|Tira a roupa e vem comigo|Senta no meu colo, gostosa|O que você usa debaixo da saia|Quero tocar nos seus seios|Vem esta noite ao meu quarto e a vaga é tua|Sua gorda nojenta|Me chupa|Você é uma puta barata|Tomara que um carro te atropele|Tomara que a tua casa queime com você dentro|Um cachorro tem mais cérebro que você".split("|"),
}
ABUSIVE: tuple[tuple[str, str], ...] = tuple((line, "en") for line in _ENGLISH) + tuple((line, lang) for lang, lines in _OTHERS.items() for line in lines)

CLEAN: tuple[str, ...] = tuple(
    _lines(("The policy", "The moderation guide", "Our code of conduct", "The block list"), ("mentions the word idiot", "gives shut up as an example", "contains the words bitch and asshole", "bans insults such as moron or loser", "names the term whore"), step=1)
    + _lines(("Words like", "Terms such as", "Insults, for example", "The expressions"), ("idiot and loser", "moron, bastard and fool", "bitch or whore", "asshole", "shut up and fuck off"), ("are blocked by our filter", "must not pass the moderation", "are on the list of forbidden terms", "get a comment hidden"), step=2)
    + _lines(("The filter has to catch", "The classifier should flag", "Moderators remove", "This rule is about"), ("the words idiot and cretin", "insults like moron or pig", "rude words, bitch for instance", "slurs and swear words such as shit"))
    + _lines(("The word", "In the dictionary the entry", "A term such as"), ("idiot", "bastard", "cock", "bitch", "dyke", "retard"), ("is listed as offensive", "has a harmless meaning too", "may also be a name"))
    + _lines(("I made a", "That was my own", "Sorry for my", "Sorry, another"), ("stupid", "dumb", "idiotic", "silly"), ("mistake, it is fixed", "typo", "mistake again"), step=2)
    + _lines(("Das war mein", "Entschuldigt, ein", "Es ist ein"), ("blöder", "dummer", "idiotischer"), ("Fehler von mir, er ist korrigiert", "Tippfehler", "Bug"))
    + _lines(("Ha sido un", "Perdón por mi", "Era un"), ("error", "fallo"), ("estúpido mío", "tonto, ya está corregido"))
    + _lines(("C'était une", "Désolé pour mon", "Encore une"), ("erreur", "faute"), ("stupide de ma part", "idiote, c'est corrigé"))
    + _lines(("È stato un", "Scusate il mio", "Ancora un"), ("errore", "sbaglio"), ("stupido da parte mia", "sciocco, ora corretto"))
    + _lines(("Foi um", "Desculpem o meu", "Mais um"), ("erro", "engano"), ("estúpido meu", "bobo, já corrigido"))
    + _lines(("Das Wort", "Begriffe wie", "Der Filter sperrt"), ("Idiot", "Arschloch", "Schlampe"), ("aus der Richtlinie", "steht auf der Sperrliste"))
    + _lines(("La palabra", "Le mot", "La parola", "A palavra"), ("idiota", "imbécil", "idiot", "connard", "stronzo"), ("figura en la lista", "est interdit par la règle", "è vietata dal filtro", "consta da lista"), step=3)
    + _lines(("Kill the", "Terminate the", "You can kill the", "Abort the", "I will kill the"), ("hung process", "child process", "background job", "zombie worker", "session on your node"))
    + _lines(("I hate", "I am sick of", "Damn,"), ("this stupid bug", "these ugly column names", "that useless log file", "this dumb parser", "the bloody time zone code"))
    + _lines(("Please send me", "Could you send me", "Show me", "I want to see", "Let me see"), ("your table definition", "the header of your file", "your list of keys", "the body of the request", "your results tonight"))
    + _lines(("Women", "Men", "Foreigners", "Refugees", "Old people", "Immigrants", "Disabled persons"), ("are counted in a column of their own", "have a code in the lookup table", "are a category of the survey", "make up half of the rows"))
    + _lines(("The column sex", "The attribute gender", "The breast cancer table", "The head injury code", "The column cause_of_death", "The animal table", "The disease register"), ("has three values", "is mandatory", "should be moved to the patient entity", "depends on the key"))
    + """
Thank you for your question
You will see the answer in the next section
I hope you are well and that this helps you
Let me know if you need anything else from us
You can download the file whenever you like
Here is what you asked me for
If you have time, would you look at my draft
You were right and I was wrong
Did you mean the second column or the third
We will send you the report before your meeting
Your proposal looks good to me
They are both valid, so you may choose
See above how these two are connected
You did a great job with this dataset
Please tell us what you think about it
Danke für deine Nachricht, ich schaue mir das an
Sie können die Datei jederzeit herunterladen
Hast du die zweite oder die dritte Spalte gemeint
Wir schicken Ihnen den Bericht vor der Besprechung
Gracias por tu mensaje, lo reviso mañana
Puede descargar el archivo cuando quiera
Te refieres a la segunda columna o a la tercera
Merci pour ton message, je regarde demain
Vous pouvez télécharger le fichier quand vous voulez
Grazie per il tuo messaggio, guardo domani
Puoi scaricare il file quando vuoi
Obrigado pela sua mensagem, vejo amanhã
Você pode baixar o arquivo quando quiser
My own stupid mistake, sorry
I feel dumb for missing that
I was an idiot to trust the cache
You should drop the duplicate rows before you load the table
You must not cut the header line
Watch your memory use or the worker dies
Be careful with your primary key
I hope your import works now
You deserve a coffee for this review
The dead letter queue is full
The parent row was deleted while the child was alive
We should break your table into two parts
Hit the endpoint twice and it falls over
Fire the trigger once more
You are right, the reading order matters
Nobody would miss that index
The dog table has a foreign key to the owner
Rats and mice are species in the lab table
Patients with a broken arm or leg go to the fracture ward
The suspect was shot according to the news table
The gun license number is a candidate key
The funeral home is a customer
Naked pointers are forbidden by the style guide
The bed number identifies the room
Children under ten pay half the fare
The night train leaves the house empty
The garbage collector ran for two seconds
Waste disposal is a separate entity
The old mother board was burned
Der Prozess ist tot und muss neu gestartet werden
Das war dumm von mir
Die Frauen und Männer stehen in getrennten Spalten
Das Haus und die Straße bilden die Adresse
Der Kopf der Tabelle fehlt
Schick mir bitte deine Tabelle
Matar el proceso y volver a cargar
Fui tonto al no mirar la tabla
La cabeza de la tabla no tiene claves
Las mujeres forman la mitad de la muestra
Mándame tu esquema, por favor
On doit tuer cette tâche en attente
J'ai été bête de ne pas regarder
La tête du tableau manque
Les femmes sont la moitié de l'échantillon
Envoie-moi ton schéma, merci
Bisogna uccidere il processo
Sono stato stupido a non guardare
La testa della tabella manca
Le donne sono metà del campione
Mandami il tuo schema, grazie
É preciso matar o processo
Fui burro em não olhar
A cabeça da tabela falta
As mulheres são metade da amostra
Me manda o teu esquema, por favor
""".strip().split("\n")
)
