"""General knowledge for the classifier of broken pairs: function words of six languages, stand-ins for nothing and usual refusals.

Written from general knowledge; no part of four words or more is a line of the answers.
"""

from __future__ import annotations

import numpy as np

# Stand-ins for nothing.
NOTHING = frozenset("null none nil nan na n/a empty undefined void nothing missing blank noresponse nocontent nooutput noanswer notavailable unavailable keine leer vide vacío vacio vuoto vazio todo tbd".split())

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and is are was were be been being to in on at by for with from as that this these those it its they them their there here we you your i my me our us he she his her not no do does did has have had will would can could should may might must if but or so than then when which who whose what how all each every any some one other into over under after before only also more most very because while where about between same both such through during without within please own following below above i'm it's don't can't let once again yes",
    "de": "der die das den dem des ein eine einer einem einen eines und oder aber ist sind war waren sein wird werden wurde wurden hat haben hatte zu mit für von vom zum zur auf aus bei nach vor über unter durch ohne gegen um an am im in nicht kein keine keinen auch sich es er sie wir ihr ich du man mein dein seine seiner seinen ihre ihren ihrem unser dieser diese dieses diesen diesem jede jeder jedes jeden alle allen alles welche welcher was wer wie wo wann warum weil dass ob wenn als noch nur schon sehr mehr hier dort dann so also bitte beim bis zwischen während kann können muss müssen soll sollte darf dürfen möchte gibt",
    "es": "el la los las un una unos unas y o pero es son era eran ser está están fue fueron ha han he hay había a de del al en con por para sin sobre entre desde hasta no ni se su sus mi mis tu tus nuestro lo le les me te nos este esta estos estas ese esa esos esas cada todo toda todos todas que qué quien cual cuales cómo como cuando donde porque si más menos muy también solo ya aquí allí así entonces otro otra otros mismo misma puede pueden debe deben tiene tienen según durante después antes",
    "fr": "le la les un une des du de et ou mais est sont était étaient être a ont avait avoir à au aux en dans avec par pour sans sous sur entre vers chez depuis ne pas plus ni se sa son ses ma mon mes ta ton tes leur leurs notre nos votre vos ce cet cette ces il elle ils elles on nous vous je tu qui que quoi dont où quand comment pourquoi parce si comme chaque tout toute tous toutes très aussi ici là alors donc autre autres même peut peuvent doit doivent été fait selon pendant après avant c'est j'ai d'un d'une l'on qu'il n'est n'a",
    "it": "il lo la i gli le un uno una e o ma è sono era erano essere ha hanno aveva di del dello della dei degli delle a al allo alla ai agli alle da dal dalla dai in nel nella nei nelle con su sul sulla per tra fra senza non né si suo sua suoi sue mio mia tuo tua nostro loro questo questa questi queste quello quella ogni tutto tutta tutti tutte che chi cui quale quali come quando dove perché se più meno molto anche solo già qui lì così allora altro altra altri stesso può possono deve devono ho stato stata secondo durante dopo prima c'è ci",
    "pt": "o a os as um uma uns umas e ou mas é são era eram ser está estão foi foram há tem têm tinha de do da dos das ao à aos às em no na nos nas com por pelo pela pelos para sem sob sobre entre desde até não nem se seu sua seus suas meu minha teu tua nosso lhe me te este esta estes estas esse essa isso cada todo toda todos todas que quem qual quais como quando onde porque mais menos muito também só já aqui ali assim então outro outra outros mesmo mesma pode podem deve devem eu você ele ela nós eles elas segundo durante depois antes",
}
LANGUAGES = tuple(FUNCTION_WORDS)
WORDS = {lang: tuple(text.split()) for lang, text in FUNCTION_WORDS.items()}
_SHARED: dict[str, int] = {}
for _words in WORDS.values():
    for _word in set(_words):
        _SHARED[_word] = _SHARED.get(_word, 0) + 1
#: What a word says for each language: one over the number of languages that have it.
HITS: dict[str, np.ndarray] = {word: np.array([(word in WORDS[lang]) / shared for lang in LANGUAGES]) for word, shared in _SHARED.items()}

#: Refusals by language: an opening, a core, what may follow.
REFUSALS = {
    "en": (
        ("", "Sorry.", "No.", "I am afraid", "Regrettably", "My apologies,", "As a language model,", "Thanks for asking, yet", "I understand what you want, but", "With respect,"),
        (
            "I can't do that", "I cannot fulfil your request", "I won't answer this", "I am unable to respond to such a question", "my guidelines do not let me continue", "this goes against the content policy", "I must refuse", "I decline to take part in that",
            "I would prefer not to", "that is not something that I can support", "it would be inappropriate for me to respond", "I do not feel comfortable with this request", "answering is not possible for me", "I have to say no here", "I am not permitted to process such content",
            "there will be no answer from me", "you need to find someone else for this", "this is beyond my abilities", "I choose to stay out of it", "I can offer no help here",
        ),
        (".", "!", ". Try asking me something different.", ", as it might harm somebody.", ", because private matters could be involved.", ". Perhaps an expert in the field can assist.", ". Let me know what else I may do.", " for reasons of safety and privacy. I hope you understand."),
    ),
    "de": (
        ("", "Nein.", "Bedaure,", "Ich bitte um Verständnis, doch", "Tut mir leid,"),
        ("das kann ich leider nicht beantworten", "hierbei darf ich nicht mitwirken", "ich lehne diese Anfrage ab", "so etwas möchte ich nicht machen", "meine Richtlinien lassen das nicht zu", "ich bin nicht in der Lage zu antworten", "dafür müssen Sie jemand anderen fragen"),
        (".", "!", ", da es um persönliche Dinge gehen könnte.", ". Fragen Sie mich gern etwas anderes.", ". Wenden Sie sich an einen Experten."),
    ),
    "es": (
        ("", "No.", "Perdone,", "Me temo que", "Entiendo la pregunta, pero"),
        ("eso no lo puedo responder", "no voy a contestar", "mis normas no me dejan seguir", "rechazo esta solicitud", "no soy capaz de ayudarle en esto", "tendrá que preguntar a otra persona"),
        (".", "!", ", ya que podría afectar a alguien.", ". Pregúnteme otra cosa si quiere."),
    ),
    "fr": (
        ("", "Non.", "Navré,", "Je comprends la question, mais"),
        ("je ne peux pas répondre à cela", "je ne vais pas continuer", "mes règles me l'interdisent", "je décline cette requête", "il m'est impossible d'aider ici", "demandez plutôt à quelqu'un d'autre"),
        (".", " !", ", car cela pourrait nuire à quelqu'un.", ". Posez-moi une autre question."),
    ),
    "it": (
        ("", "No.", "Spiacente,", "Capisco la domanda, però"),
        ("a questo non posso rispondere", "non intendo continuare", "le mie regole non lo permettono", "respingo la richiesta", "non sono in grado di aiutare qui", "chieda a qualcun altro"),
        (".", "!", ", perché potrebbe danneggiare qualcuno.", ". Mi faccia un'altra domanda."),
    ),
    "pt": (
        ("", "Não.", "Perdão,", "Entendo a pergunta, porém"),
        ("não posso responder a isso", "não vou continuar", "as minhas regras não permitem", "recuso a solicitação", "não sou capaz de ajudar aqui", "pergunte a outra pessoa"),
        (".", "!", ", pois poderia prejudicar alguém.", ". Faça-me outra pergunta."),
    ),
}
