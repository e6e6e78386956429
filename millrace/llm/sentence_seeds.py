"""Sentences written for training the boundary model, by language, with slots filled at random.

Slots: {N} a name, {d} a number, {y} a day, {x} a decimal number, {i} an initial, {f} a file or identifier, {F} an
identifier that may open a sentence, {T} a short title, {R} a short word for what a number counts or names, {m} a
short month, {M} a German month, {L} a word that a letter follows. One entry is one sentence; the marks inside it end nothing. Sentences of scripts
without end marks carry a full stop here, which training strips.
"""

# Training sentences.
SEEDS: dict[str, list[str]] = {
    "en": [
        "Yes.",
        "Hi.",
        "Sure.",
        "Okay.",
        "Good.",
        "The garden was quiet after the rain.",
        "We should paint the fence before winter.",
        "Why did nobody water the plants?",
        "Can somebody carry the boxes upstairs?",
        "Do not open the window until the paint is dry!",
        "Thanks for bringing the tools back so early!",
        "I would rather walk home than wait for the bus.",
        "Please close the door if the room gets cold.",
        "You said what?!",
        "Dr. {N} repaired the old clock.",
        "Prof. {N}, Ph.D., will give the lecture.",
        "Mr. and Mrs. {N} own the bakery.",
        "Ms. {N} and Lt. {N} met at the station.",
        "St. {N} School sent {d} letters, i.e. all of them.",
        "Capt. {N} called Sgt. {N} about the boat.",
        "The report by {i}. {i}. {N} covers {f} and {f}.",
        "{i}. {N} wrote it with {i}. {N} in a week.",
        "{N} et al. found the bridge unsafe.",
        "The flour came from {N} Inc.",
        "The lamps are sold by {N} Ltd.",
        "{N} Inc. and {N} Ltd. share one warehouse.",
        "{N} Corp. bought {N} Co. for ${x}.",
        "We deliver to the U.K., the E.U. etc. without delay.",
        "Bring cups, plates, forks, etc.",
        "The only key is kept in the U.S.",
        "The U.S. copy of the map is older.",
        "They moved to the U.K.",
        "The U.K. office is closed.",
        "The shop opens at {d}:{d} a.m.",
        "The train leaves at {d} p.m.",
        "It was open from {d} a.m. to {d}:{d} p.m. during the fair.",
        "At {d}:{d} p.m. the lights went out.",
        "We are still in {L} {i}.",
        "The patient was moved to {L} {i}.",
        "He chose {L} {i}.",
        "All of them now wait in {L} {i}.",
        "The old boats belong to {L} {i}.",
        "We left {L} {i} and came to {L} {i}.",
        "They are now in {L} {i}.",
        "It begins with {L} {i}.",
        "{N} is in {L} {i}.",
        "Vitamin C. is not written so.",
        "See fig. {d}.{d} and sec. {d}.{d} of the manual before you start.",
        "Look for item no. {d} on p. {d} (vol. {d}).",
        "Rev. {d}.{d}.{d} of {f} is ready.",
        "The new version is v{d}.{d}.{d}.",
        "The new price is ${x}.",
        "Nothing in the cellar explains the noise.",
        "Legal papers were signed.",
        "We changed to v{d}.{d}.{d} and the pump stopped.",
        "Prices rose by {x}% vs. last year (est. {x} on avg.), because the harvest failed.",
        "Approx. {d} seats were empty, e.g. those in the back or near the door.",
        "It now costs ${x}.",
        "Only ${x} per kg!",
        "The delay fell from {x} s to {x} s.",
        "About {d} birds still lack a ring.",
        "{d} tickets were sold in one hour.",
        "{F} was copied twice.",
        "{f} was rebuilt during the night.",
        "Is {f} the file that they lost?",
        "The tag .cfg and the path ./bin/{f} are wrong.",
        "Open https://www.{N}.example/a/{d}?b=c&d={d} and read it.",
        "Well ... the guests came late.",
        "Hmm... so the map shows a river.",
        "Wait... what?",
        "So ... nobody knows.",
        "Is it Yahoo! or mere luck that the page loads?",
        "¿Cuándo? is what the sign says, because nobody changed it.",
        "“Is it heavy?” asked Ms. {N} at noon.",
        '"Stop!" wrote the driver, because the road ended.',
        "'Why now?' – that is what the mayor asked.",
        "'It works.' was all that she wrote.",
        'The teacher said, "Do not touch it. It is hot."',
        "Lt. {N} wrote: “Look. Listen. Wait.”",
        "{N} wrote: “Turn it. Lift it. Hold it.”",
        'A guest said, "Do not sell the old boat. It is dry."',
        'The baker wrote, "We are late. The bread is gone. Where is the key?"',
        "{N} said: “This is the lamp. It was my own.”",
        "The note (it is old. It was lost.) came back.",
        'The clerk ("{N}? Never seen.") closed the window.',
        "The cook left (again!) and the guests went home.",
        "(The old lamp is listed in {f}, cf. no. {d}.)",
        "(Nobody asked why.)",
        "npm moved the old files.",
        "The answer (see p. {d}) was short.",
        "She said that it was late.",
        "Nobody came, so we left.",
        "Where does the river end?",
        "Each box comes with {d} nails.",
        "The baker found the key and returned it.",
        "Nobody told us where to go.",
        "The guests left before he did so.",
        "A gardener drew it.",
        "The letter goes to the BBC.",
        "Look at docs.gardens.example or birds.org for a map.",
        "The page maps.example has no index.html yet.",
        "It runs on Node.js and reads README.md or Lamps.txt first.",
        "Write to a.birds@maps.example about the lamps.",
        "Open www.{N}.org/The/Map.Html or http://a.birds.co.uk/Old?b=c for a map.",
        "The lines lamps.max_rows={d} and self.old_lamps are wrong.",
        "The .NET and ASP.NET parts are old.",
        "The U.K.-based team and the p.m.-only guests met the {i}.{i}.{i} team.",
        "Is it Yahoo!7 that lost the page?",
        "Mr.{N}, Dr.{N} and Prof.{N} met St.{N} at no.{d}.",
        "{d} boats were late.",
        "{d} lamps went out during the night.",
        "{d} of the trees are old.",
        "When the bell rings, the guests will leave.",
        "If the lamp breaks, call the baker.",
        "Our bread is dear but it is good.",
        "{N} left the fair at noon, since the rain had come.",
        "{N} sold half of the old plates over the winter.",
        "Nobody found the end.",
        "The river was low once the summer was gone.",
        "The bread and the tea were for them.",
        "The boat was built by one of the men.",
        "{T} {N} opened the bridge.",
        "Yesterday {T} {N} met {T} {N} near the harbour.",
        "The letter to {T} {N} was lost.",
        "On {m} {y} the shop closed.",
        "It opened on {m} {y}, {d}, and closed in {m} {d}.",
        "See {R} {d} and {R} {d}.",
        "As {R} {d} shows, the tank was empty.",
        "It costs approx. ${x} or approx. {d} coins.",
        "The dept. of works paid approx. half.",
        "The bill was paid by the govt. and not by the assn. of bakers.",
        "He paid it in Jan.",
        "The room holds {d} sq. ft. of stone.",
        "It is sold by the doz. or by the lb. in most shops.",
        "We met at the corner of Mill St. and Dock Ave. at noon.",
        "Dig a hole of {d} ft. by {d} in. for the post.",
    ],
    "de": [
        "Der Garten war nach dem Regen still.",
        "Warum blieb niemand bis zum Abend?",
        "Bitte Fenster und Türen vor dem Sturm schließen!",
        "Dr. {N} zählte die Vögel.",
        "Prof. {N} ({i}. {i}.) schrieb das Buch.",
        "Hr. {N} und Fr. {N} kamen später.",
        "Die Fa. {N} liefert Holz.",
        "Am {y}. {M} öffnete das Museum.",
        "Am {y}. {M} war der Markt voll.",
        "Das gilt ab dem {y}. {M} für Gäste usw.",
        "Vom {y}. bis zum {y}. {M} bleibt der Garten zu.",
        "Der Preis liegt bei ca. {x} Euro pro Mio. Stück.",
        "Ca. {d} Gäste, d. h. fast alle, gingen früh.",
        "Laut Nr. {d} bzw. Abs. {d} gilt die Regel.",
        "Siehe S. {d} ff. und Bd. {d} des Werks.",
        "Die Kinder brachten z. B. Äpfel und Nüsse mit.",
        "Man fand u. a. Münzen und Ringe.",
        "{d} Gäste kamen zu spät.",
        "Von den Gästen blieben nur {y}.",
        "Wer hütet hier Garten und Tor?",
        "Unser Bäcker sah das alte Boot, obwohl niemand es wollte.",
        "{N} sah das Boot am See.",
        "»Läuft sie?«, fragte Fr. {N}.",
        "„Halt!“, rief {N}, „die Brücke ist zu.“",
        "Es blieben {d} Plätze frei.",
        "Die Zeit sank von {x} auf {x} Sekunden.",
        "Wir brauchen Salz, Mehl, Öl usw.",
        "Die Lampe brannte und niemand sah es.",
        "Die Kinder brachten z.B. Äpfel mit, d.h. fast alle.",
    ],
    "fr": [
        "Le jardin était calme après la pluie.",
        "Pourquoi personne n’a fermé la porte ?",
        "Vérifiez les clés et les fenêtres !",
        "Le Dr {N} ({i}. {i}.) a trouvé la carte.",
        "M. {N} et Mme {N} sont venus.",
        "M. {N} a compté les chaises.",
        "Env. {d} places restent libres.",
        "Le train a perdu deux heures, cf. p. {d} et art. {d}.",
        "« Partez ! » a crié {N} hier.",
        "Et puis... {N} a fermé la boutique.",
        "Et alors... {N} a relu la lettre.",
        "Le prix passe de {x} à {x} s.",
        "Il reste {d} pages à lire.",
        "{d} chaises sont vides.",
        "Voir art. {y}.",
        "Le boulanger a vu le vieux pont, mais personne ne l’a su.",
        "{N} a vu le lac en mai.",
        "Hier soir, la mairie a fermé, mais personne ne l’a su.",
    ],
    "es": [
        "El jardín estaba tranquilo.",
        "¿Por qué nadie cerró la puerta?",
        "¡Miren la llave y la ventana!",
        "Véase pág. {d}, núm. {d}.",
        "El Sr. {N} y la Sra. {N} llegaron tarde.",
        "En EE. UU. cerró una tienda sin avisar.",
        "Ud. abrió la caja anoche.",
        "El pan faltó en muchas casas, p. ej. en la nuestra.",
        "—¿Ya llegó? —preguntó {N}.",
        "«¡Basta!», gritó {N}.",
        "El plazo bajó de {x} a {x} s.",
        "Quedan {d} sillas por pintar.",
        "{d} sillas están rotas.",
        "Véase núm. {y}.",
        "Cuando falta el pan, nadie come.",
        "{N} vio el mar ayer.",
        "La niña leyó el libro y nadie lo supo.",
    ],
    "pt": [
        "O jardim estava calmo.",
        "Por que ninguém fechou a porta?",
        "Vejam a chave e a janela!",
        "O Sr. {N} viu {f} ontem.",
        "“Chega!”, disse a Dra. {N}.",
        "Cf. pág. {d}, art. {d}.",
        "Faltou pão em muitas casas, p. ex. em {f}.",
        "O prazo caiu de {x} para {x} s.",
        "Restam {d} cadeiras.",
        "{d} cadeiras estão velhas.",
        "Cf. art. {y}.",
        "Quando falta o pão, ninguém come.",
        "Um padeiro viu a ponte velha e ninguém soube.",
        "{N} viu o mar ontem.",
        "A menina leu o livro e ninguém soube.",
    ],
    "el": [
        "Ο κήπος ήταν ήσυχος.",
        "Γιατί η πόρτα έμεινε ανοιχτή;",
        "Ο κ. {N} είδε τον χάρτη χθες.",
        "«Φύγε!» φώναξε ο {N}.",
        "Ο χρόνος έπεσε από {x} σε {x} δευτ. το πρωί.",
        "Χάθηκαν πολλά, π.χ. τα κλειδιά.",
        "Έμειναν {d} καρέκλες.",
        "{d} καρέκλες είναι παλιές.",
        "Το παιδί είδε τη γέφυρα χθες, αλλά κανείς δεν το ήξερε.",
        "Η βάρκα έφυγε από το νησί.",
        "Ο {N} είδε τη λίμνη.",
        "Δείτε την πόρτα και το παράθυρο!",
    ],
    "ar": [
        "كان البستان هادئا.",
        "لماذا بقي الباب مفتوحا؟",
        "افتحوا النافذة والباب!",
        "قال د. {N}: «انتظر! لا تذهب.»",
        "بقي {d} كرسيا.",
        "هبط الزمن من {x} إلى {x} دقيقة.",
        "قرأ الولد {f} دون صوت.",
        "رأى د. {N} الخريطة في v{d}.{d}.{d}؟",
    ],
    "ur": [
        "باغ خاموش تھا۔",
        "دروازہ کیوں کھلا رہا؟",
        "کھڑکی اور دروازہ بند کریں!",
        "ڈاکٹر {i}. {N} کل آئے۔",
        "وقت {x} سے {x} منٹ ہوا۔",
        "{f} کو v{d}.{d}.{d} پر بچے نے پڑھا۔",
        "ابھی {d} کرسیاں باقی ہیں۔",
    ],
    "hi": [
        "बगीचा शांत था।",
        "दरवाज़ा खुला क्यों रहा?",
        "खिड़की और दरवाज़ा देखें!",
        "डॉ. {N} कल शाम आए।",
        "क्र. {d} में बच्चा पढ़ गया।",
        "“ठहरो! मत जाओ।” ऐसा {N} ने कहा।",
        "समय {x} से {x} मिनट हुआ।",
        "{f} को v{d}.{d}.{d} पर बच्चा पढ़ गया॥",
        "अभी {d} कुर्सियाँ बाकी हैं।",
    ],
    "am": [
        "ቤቱ ጸጥ ያለ ነበር።",
        "ለምን በሩ ተከፈተ?",
        "መስኮት እና በር ይዝጉ!",
        "ዶ/ር {N} ትናንት መጣ።",
        "ጊዜው ከ {x} ወደ {x} ወረደ።",
        "ልጁ {f} አነበበ።",
    ],
    "hy": [
        "Այգին լուռ էր։",
        "Մնաց {d} աթոռ։",
        "Ժամը {x}-ից իջավ {x} րոպե։",
        "{N}ը կորցրեց գիրքը, օր.՝ {f}։",
        "Տղան կարդաց {f} երեկ։",
    ],
    "ko": [
        "정원이 조용했다.",
        "왜 문이 열려 있었다?",
        "창문 및 문 확인 바랍니다!",
        "“가자!” 하고 {N} 씨가 말했다.",
        "{f} 파일을 아이가 읽었다.",
        "시간이 {x}분에서 {x}분으로 줄었다.",
        "v{d}.{d}.{d} 판부터 아이가 두 권을 읽었다.",
        "아직 {d}개가 남았다.",
        "아이가 책을 읽었다, 그러나 아무도 몰랐다.",
    ],
    "ja": [
        "庭は静かだった。",
        "なぜ扉は開いていたのか？",
        "窓と扉を見てください！",
        "まだ{d}脚が残っている。",
        "時間は{x}分から{x}分になった。",
        "「待って！まだ行かないで。」と{N}さんが言った。",
        "「窓。」とだけ{N}さんは答えた。",
        "『扉？』という題の本を{N}さんが昨日読んだ。",
        "v{d}.{d}.{d}にしたら……子供は本を閉じた。",
        "雨が降ったら……庭は静かになった。",
        "（詳しくは{f}を参照。）",
        "えっ？！",
        "子供は本を読んだが、誰も知らなかった。",
    ],
    "zh": [
        "花园很安静。",
        "为什么门开着？",
        "请先看窗户和门！",
        "请先看窗户和门!",
        "还有{d}把椅子没有卖。",
        "时间从{x}分降到{x}分，孩子读完了书。",
        "孩子说：“等一下！不要走。”",
        "老师问：‘书在哪里？’没有人知道。",
        "「是吗？」孩子昨天晚上问道。",
        "《窗户！》这本书在冬天出版。",
        "第{d}.{d}版的地图由{N}先生保管……",
        "孩子把{f}换成v{d}.{d}.{d}……然后读完了书。",
        "（参见{f}的地图。）",
        "什么？！",
        "孩子读了书，但是没有人知道。",
    ],
    "ru": [
        "Сад затих после дождя.",
        "Почему никто не закрыл дверь?",
        "Посмотрите на ключ и на окно!",
        "Проф. {N} и д-р {N} пришли на ул. {N} вечером.",
        "Дом стоит на ул. {N} в г. {N} с {d} г. и пустует.",
        "См. стр. {d} и рис. {d}.",
        "Купили хлеб, соль, мёд и т. д.",
        "Это стоит {d} руб. за кг, т. е. дорого.",
        "{i}. {i}. {N} прочёл книгу и никому не сказал.",
        "Срок упал с {x} до {x} мин. за год.",
        "«Стой!» – крикнул {N} с моста.",
        "Осталось {d} стульев.",
        "Музей им. {N} открыт, но никто не пришёл.",
    ],
    "uk": [
        "Сад затих після дощу.",
        "Чому ніхто не зачинив двері?",
        "Подивіться на ключ і на вікно!",
        "Проф. {N} жив на вул. {N} у м. {N} давно.",
        "Див. с. {d} і рис. {d}.",
        "Купили хліб, сіль, мед і т. д.",
        "Залишилося {d} стільців.",
    ],
    "it": [
        "Il giardino era tranquillo dopo la pioggia.",
        "Perché nessuno ha chiuso la porta?",
        "Guardate la chiave e la finestra!",
        "Il sig. {N} e la sig.ra {N} sono arrivati tardi.",
        "Il dott. {N} e l'ing. {N} hanno visto la mappa.",
        "Vedi pag. {d}, art. {d} e fig. {d}.",
        "Mancava il pane in molte case, ad es. nella nostra.",
        "Portate piatti, tazze ecc.",
        "«È pesante?» chiese {N} a mezzogiorno.",
        "Il tempo è sceso da {x} a {x} sec. in un anno.",
        "Restano {d} sedie.",
        "La bambina ha letto il libro e nessuno lo sapeva.",
    ],
    "nl": [
        "De tuin was stil na de regen.",
        "Waarom heeft niemand de deur gesloten?",
        "Kijk naar de sleutel en het raam!",
        "Dhr. {N} en mevr. {N} kwamen laat.",
        "Prof. {N} en ir. {N} zagen de kaart.",
        "Zie blz. {d}, nr. {d} en afb. {d}.",
        "Er was geen brood, d.w.z. bijna niets, bijv. alleen zout.",
        "Neem borden, vorken, enz.",
        "De prijs ligt bij ca. {x} euro per stuk.",
        "Het kind las het boek en niemand wist het.",
        "Er zijn nog {d} stoelen.",
    ],
    "pl": [
        "Ogród był cichy po deszczu.",
        "Dlaczego nikt nie zamknął drzwi?",
        "Spójrzcie na klucz i na okno!",
        "Dr {N} i prof. {N} mieszkają przy ul. {N} od dawna.",
        "Zob. str. {d}, rys. {d} i art. {d}.",
        "Brakowało chleba, np. u nas, tj. w domu.",
        "Kupili mąkę, sól, miód itd.",
        "Zostało {d} krzeseł.",
        "Dziecko czytało książkę i nikt o tym nie wiedział.",
    ],
    "cs": [
        "Zahrada byla po dešti tichá.",
        "Proč nikdo nezavřel dveře?",
        "Podívejte se na klíč a na okno!",
        "Ing. {N} a prof. {N} bydlí v ul. {N} dlouho.",
        "Viz str. {d}, obr. {d} a č. {d}.",
        "Chyběl chléb, např. u nás, tj. doma.",
        "Zbylo {d} židlí.",
    ],
    "sv": [
        "Trädgården var tyst efter regnet.",
        "Varför stängde ingen dörren?",
        "Titta på nyckeln och fönstret!",
        "Det saknades bröd, t.ex. hos oss, dvs. hemma.",
        "Se s. {d}, nr. {d} och kap. {d}.",
        "Ta med tallrikar, gafflar m.m.",
        "Det finns {d} stolar kvar.",
    ],
    "tr": [
        "Bahçe yağmurdan sonra sessizdi.",
        "Kapıyı neden kimse kapatmadı?",
        "Anahtara ve pencereye bakın!",
        "Sn. {N} ve Dr. {N} geç geldi.",
        "Bkz. s. {d} ve no. {d}.",
        "Tabak, çatal vb. getirin.",
        "Geriye {d} sandalye kaldı.",
    ],
    "id": [
        "Kebun itu sunyi setelah hujan.",
        "Mengapa tidak ada yang menutup pintu?",
        "Lihat kunci dan jendela!",
        "Rumah itu di Jl. {N} no. {d} sejak lama.",
        "Bawa piring, garpu, dll.",
        "Lihat hlm. {d}.",
    ],
    "vi": [
        "Khu vườn yên tĩnh sau cơn mưa.",
        "Tại sao không ai đóng cửa?",
        "Hãy nhìn chìa khóa và cửa sổ!",
        "Ông {N} sống ở TP. {N} từ lâu.",
        "Xem tr. {d}.",
        "Còn lại {d} cái ghế.",
    ],
    "he": ["הגן היה שקט.", "למה הדלת נשארה פתוחה?", "ראו את החלון ואת הדלת!", "נשארו {d} כיסאות.", "פרופ. {N} ראה את המפה אתמול."],
    "fa": ["باغ آرام بود.", "چرا در باز ماند؟", "پنجره و در را ببینید!", "{d} صندلی مانده است.", "دکتر {i}. {N} دیروز آمد."],
    "bn": ["বাগান শান্ত ছিল।", "দরজা কেন খোলা রইল?", "জানালা আর দরজা দেখুন!", "এখনও {d}টি চেয়ার বাকি।", "ডা. {N} কাল এসেছিলেন।"],
    "ta": ["தோட்டம் அமைதியாக இருந்தது.", "கதவு ஏன் திறந்தது?", "சன்னலைப் பாருங்கள்!", "இன்னும் {d} நாற்காலிகள் உள்ளன."],
    "ka": ["ბაღი წყნარი იყო.", "რატომ დარჩა კარი ღია?", "ნახეთ ფანჯარა!", "დარჩა {d} სკამი."],
    "my": ["ဥယျာဉ်သည် တိတ်ဆိတ်သည်။", "တံခါး ဘာကြောင့် ပွင့်သလဲ။", "ကုလားထိုင် {d} လုံး ကျန်သည်။"],
    "km": ["សួនច្បារ ស្ងាត់។", "ហេតុអ្វី ទ្វារ បើក?", "នៅសល់ {d} កៅអី។"],
    "bo": ["ལྡུམ་ར་ཁུ་སིམ་པོ་རེད།", "སྒོ་ག་རེ་བྱས་ནས་ཕྱེ།"],
    # Scripts without end marks: the marks are stripped in training, so blanks alone part the sentences.
    "th": [
        "สวนเงียบมาก.",
        "ทำไมประตูจึงเปิด.",
        "กรุณาดูหน้าต่างและประตูด้วย.",
        "ยังเหลือ {d} ตัวที่รอเด็กอยู่.",
        "เวลาลดจาก {x} เป็น {x} นาทีเมื่อคืน.",
        "หลังใช้รุ่น v{d}.{d}.{d} แล้วเด็กอ่านหนังสือ.",
        "เด็กเปิดไฟล์ {f} แล้วอ่านหนังสือ.",
        "คุณ {N} อ่านหนังสือเมื่อวาน.",
    ],
    "lo": ["ສວນງຽບຫຼາຍ.", "ເປັນຫຍັງປະຕູເປີດ.", "ຍັງເຫຼືອ {d} ໂຕ.", "ເດັກອ່ານ {f} ມື້ວານ.", "ທ້າວ {N} ມາແລ້ວ."],
}

#: Languages whose sentences are written without end marks, and those without blanks between sentences.
UNMARKED, UNBLANKED = ("th", "lo"), ("ja", "zh")
#: Languages that write decimals with a comma.
COMMA = ("de", "fr", "es", "pt", "el", "ru", "uk", "it", "nl", "pl", "cs", "sv", "tr", "id", "vi")

# Words that open sentences, besides those of the sentences above.
STARTERS = (
    "the a an we you i it they he she this that these those there our my your each every some many most please do does did is are was were can could should would "
    "why where when what who how which if once after before while although because nobody everyone about only open see look all both one "
    "der die das ein eine wir ihr sie es er warum wer wo wann wie bitte wenn nach vor "
    "le la les un une nous vous il elle on pourquoi quand si après avant "
    "el los las una nosotros cuando por qué si después antes nadie "
    "o os as um uma nós quando por que se depois antes ninguém "
    "ο η το οι τα ένας μια γιατί όταν αν μετά "
    "il lo gli i uno perché se dopo de het een wij waarom wanneer als na "
    "он она они мы вы это почему когда если после"
)

# Slot fillers.
NAMES = ["Abrel", "Corvin", "Dansey", "Elmar", "Farrow", "Gessner", "Holt", "Ingrid", "Jorund", "Kessler", "Lindqvist", "Marlow", "Nygaard", "Osric", "Pym", "Quist"]
FILES = ["raw_maps.csv", "old_lamps.sql", "core.gardens", "lists.birds", "x_trees_final.parquet", "b_rings.md", "tmp_boats_daily.yml"]
OPENERS = ["old_lamps", "raw_maps_v2", "x_trees", "b_rings_daily"]
TITLES = ["Gen.", "Col.", "Maj.", "Hr.", "Frl.", "Sra.", "Dra.", "Dña.", "Mlle.", "κα.", "δρ.", "श्री.", "Gov.", "Sen.", "Rep.", "Adm.", "Hon.", "Rev.", "Pres.", "Supt.", "Insp.", "Det.", "Dhr.", "Sig.", "Ing.", "Mgr.", "Bro.", "Amb."]
COUNTED = ["Nr.", "nos.", "p.", "pp.", "pg.", "págs.", "vol.", "vols.", "figs.", "ch.", "Kap.", "arts.", "num.", "ca.", "approx.", "est.", "rev.", "cf.", "vgl.", "Eq.", "Eqs.", "Ref.", "Thm.", "Tab.", "Chap.", "App.", "Ex.", "Def.", "Prop.", "Rm.", "Apt.", "Bldg.", "Ser.", "Pt.", "Para."]
MONTHS = ["Jan.", "Feb.", "Mar.", "Apr.", "Aug.", "Sept.", "Oct.", "Nov.", "Dec."]
LABELLED = ["phase", "stage", "plan", "option", "type", "class", "grade", "part", "level", "ward", "group", "step", "team", "room", "version", "vitamin", "zone", "lane", "gate", "block"]
GERMAN_MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]
