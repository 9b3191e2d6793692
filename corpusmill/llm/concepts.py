"""What words are about, in English, French, German and Spanish: a general dictionary by which a word shares the weights of its like.

It says nothing of how much a word offends. That is learned from the labelled sentences, for each concept as for each
word: a threat labelled in English teaches what words for harm, bodies and addressing somebody weigh in all languages.
Words are folded (no accents); ``*`` stands for any ending.
"""

from __future__ import annotations

#: Fixed values. A word belongs to the first concept that names it whole, else to that which names its longest beginning.
#: Words that mean something else in another of the languages and are common there (die, con, son) are left out.
CONCEPTS = {
    "addressed": """you your yours yourself ya ur youre youll
        tu te toi ton ta tes vous votre vos
        du dich dir dein deine deinen deinem deiner deines euch euer eure
        ti tus tuyo tuya contigo eres usted ustedes vosotros""",
    "speaker": """i my mine myself ill je j moi mon ma mes ich mich mir mein meine meinen meinem meiner yo mi mis conmigo""",
    "ours": """we us our ours ourselves nous notre nos wir uns unser unsere unserem unseren unserer nosotros nuestro nuestra nuestros nuestras""",
    "none": """nobody noone never aucun aucune jamais personne nulle kein keine keiner keinen keinem keines nie niemals niemand
        ningun ninguna ninguno nunca jamas nadie""",
    "harm": """kill murder* slaughter* stab stabs strangle* shoot shoots hang lynch* burn beat beaten
        break breaks smash* crush* slit choke* drown* bash punch* whip torture* butcher* rape maim* cripple* hit hurt wound* cut skin
        tue tuerai casse casser casserai cassera frapper frappe frapperai egorg* etrangl* bruler brule brulez brulerai massacr* poignard* assassin* tabass* cogner cogne noyer noie fracass* pendre pendez
        toten tote totet getotet umbring* erschlag* erstech* erwurg* erschiess* verbrenn* brech* brich* zerschlag* schlag* verprugel* prugel* aufhang* erhang* ertrank* zertret*
        matar mato matare matamos maten romper rompo rompere rompemos golpear golpeo golpeare pegar pego pegare quemar quemo quemen quemad degoll* apunal* estrangul* ahorc* ahog* disparar disparo fusil* aplast* machac* reventar reviento""",
    "weapon": """hammer hammers knife knives gun guns axe rope noose bullet bullets bomb bombs acid machete blade rifle pistol
        couteau couteaux marteau pistolet hache corde balle balles bombe messer pistole gewehr axt strick kugel kugeln beil waffe waffen
        cuchillo cuchillos martillo pistola hacha soga bala balas bomba navaja""",
    "body": """leg legs arms bone bones tooth teeth jaw skull skulls neck throat face faces mouth nose finger fingers knee knees rib ribs head brain brains guts spine tongue
        jambe jambes dent dents machoire crane gorge gueule visage bouche nez doigt doigts genou genoux tete cerveau langue
        bein beine beinen knochen zahn zahne zahnen kiefer schadel hals kehle gesicht mund maul fresse nase finger knie rippe rippen kopf gehirn genick zunge klappe schnauze
        pierna piernas brazo brazos hueso huesos diente dientes mandibula craneo cuello garganta cara boca nariz dedo dedos rodilla rodillas costilla costillas cabeza cerebro lengua""",
    "perish": """dying dead death rot rots rotting grave graves coffin coffins corpse corpses funeral vanish* disappear* perish* hell
        mourir meurs meure morte tombe cercueil cadavre cadavres creve crever creves pourrir pourris disparais disparaitre disparaisse
        sterben stirb stirbst tod grab sarg leiche leichen verreck* verrott* verschwind* krepier* holle
        morir muere muerete mueras muerto muerta muerte tumba ataud cadaver cadaveres pudrete pudras pudrirte desaparec* desaparezc* infierno""",
    "away": """go back away leave out lost home come comeback returning again
        reviens revenir revient retourne retourner retournez dehors degage degagez
        kommst komm komme kommt zuruck raus geh gehst hau verpiss* wiederkomm* nochmal
        vuelve vuelves vuelvas volver vete vayanse fuera largate larguense regres*""",
    "expel": """expel* deport* evict* banish* kick kicked throw thrown exterminat* eradicat* purge purged cleanse* wipe wiped drive driven chase chased send sent remove removed ban banned
        chasser chasse chassez chassons expuls* bannir bannis extermin* elimin* virer virez
        verjag* vertreib* vertrieb* rauswerf* rausgeworf* hinauswerf* hinausgeworf* ausweis* ausgewies* abschieb* abgeschob* vernicht* ausrott* ausgerott* rausschmeiss*
        echar echarlos echarlas echemos echad desterr*""",
    "entitled": """allowed allow right rights deserve deserves deserved belong belongs place vote marry own entitled permitted live lives stay among beside exist welcome
        droit droits merite meritent meriter place appartien* permis vivre vivent parmi
        recht rechte verdient verdienen gehor* platz durfen darf dulden leben
        derecho derechos merece merecen merecer lugar sitio pertenec* permitido vivir viven convivir""",
    "kin": """people families family blood race races breed* tribe tribes folk folks neighbours quarter children mother father wife daughter         gens familles famille peuple meres enfants mere fille leute familien familie blut rasse rassen volk sippe sippen kinder mutter tochter
        gente familias familia sangre raza razas pueblo hijos madre hija""",
    "vermin": """vermin rat rats cockroach* parasite* plague filth subhuman* animals beast beasts lice louse swarm* infest* crawl* scum disease pests maggot* leech* savages
        vermine cafard cafards parasites peste nuisibles racaille rampent ordures ratten kakerlak* parasit* abschaum schadling* untermensch* kriech* gesindel         alimana* rata ratas cucaracha* plaga escoria gusano* bestias""",
    "criminal": """liar liars thief thieves criminal criminals murderers rapists cheats cheaters traitor traitors scammers
        menteur menteurs voleur voleurs criminel criminels traitre traitres lugner diebe verbrecher betruger verrater mentiroso mentirosos ladron ladrones criminales traidor traidores""",
    "insult": """idiot* moron* imbecil* cretin* stupid* dumb* fool fools ass asshole* arse* bitch* whore* slut* bastard* jerk jerks loser* clown* dimwit* halfwit* twat* cunt* dick dickhead* prick* wanker* fuck* shit*
        damn damned crap trash garbage worthless useless pathetic disgust* miserable brainless ugly coward* creep creeps pig pigs swine rotten ashamed disgrace* shame hate hates despis* loath* nonsense scumbag*
        abruti* salaud* salope* connard* connasse* conne debile ordure minable* bouffon* merde* pute putes batard* encul* raclure* crapule* lache honte degout* pourriture*
        trottel* dummkopf* dumm* schwachkopf* arsch* mistkerl* versager* vollpfosten* depp* blod* scheiss* hurensohn* hure* schwein* drecks* wichser* fotze* wertlos* erbarmlich* schande widerlich* ekelhaft*
        idiota* payaso* canalla* basura inutil* estupid* tonto tonta tontos gilipollas pendej* cabron* puta putas puto hijoputa* mierda maricon* cobarde* asqueros* patetic* verguenza""",
    "silence": """shut shutup mouthing talk talking asked ferme tais taisez ferma halt maul schweig* callate calla callaos""",
    "nude": """naked nude* topless undress* bare strip stripped stripping lingerie nu nue nus nues deshabill* seins nackt* entbloss* ausgezogen desnud* breast breasts nipple* tits busen brust* titten pechos tetas""",
    "arousal": """moan* pleasure* touch touched thigh* kiss kissed kisses kissing lick* caress* thrust* climax* orgasm* bed whisper* begging lust desire panting gasp*
        plaisir* gemi* caress* cuisse* jouir jouissance embrass* desir stohn* schenkel* kuss* streichel* begierde placer* muslo* acarici* beso besos besar deseo""",
    "explicit": """sex sexy horny erotic* arous* lustful porn* xxx* uncensored explicit hardcore cock pussy cum blowjob* naughty kinky fetish*
        sexe erotiq* excit* baise* nichons chatte censure* censuree* coquin* geil* erotisch* fick* muschi unzensiert* zensur* versaut* sexo caliente calientes follar* polla censura* cachond*""",
    "show": """watch video* clip clips camera webcam* cam cams couple couples singles girls amateur* adult adults eighteen tonight hot
        paare paar erwachsene erwachsenen heiss heisse heisser heissen cam frauen adultes adulte chaud chaude pareja parejas adultos adulto mayores""",
    "better": """better happier favour favor cleaner safer mieux heureux heureuse service besser glucklicher sauberer sicherer gefallen mejor felices limpio""",
    "recounted": """accident* disaster* incident* victim* court courts tribunal judge judges condemn* convict* sentenced report* journalis* hospital* doctor* surgeon* surgery clinic* patient* dentist* medic* health* cancer screening anatom* law laws citizens constitution* newspaper* historian* history propaganda pamphlet* moderator* police investigat* witness* claimed explain* rescue* rebuilt repaired
        kills killed killing stabbed shot hanged burns burned burnt broken whipped wounded injured
        incendie incendies victime* condamn* tract juge juges historien* expliquent explique signale hopita* chirurg* loi lois citoyens sante rapport* enquete* temoin* tue tues blesse blesses
        unfall unfalle opfer gericht verurteil* flugblatt historiker* zeitung* bericht* polizei krankenhaus arzt* zahnarzt* gesetz* burger* gesundheit* ermittl* zeuge* erklart erklaren erklarte getotet umgebracht verletzt gebrochen
        accidente* victima* conden* panfleto* juez historiador* periodico* informe* policia ley leyes ciudadan* salud testigo* explica explican explico heridos muertos""",
}


class Concepts(dict):
    """word -> concept, for whole words; beginnings apart."""

    def __init__(self, concepts: dict[str, str] = CONCEPTS):
        super().__init__()
        self.beginnings: dict[str, str] = {}
        for concept, listed in concepts.items():
            for word in listed.split():
                (self.beginnings if word.endswith("*") else self).setdefault(word.rstrip("*"), concept)
        self.longest, self.shortest = max(map(len, self.beginnings)), min(map(len, self.beginnings))

    def of(self, word: str) -> str | None:
        found = self.get(word)
        for n in range(min(self.longest, len(word)), self.shortest - 1, -1) if found is None else ():
            if found := self.beginnings.get(word[:n]):
                break
        return found
