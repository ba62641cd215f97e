"""A first text for each language of the code table that has no script of its own: the opening of a well-known
declaration, and common words. Detection without labelled texts learns its profiles from these."""

from __future__ import annotations

# Code and text.
SAMPLES = {
    "eo": "Ĉiuj homoj estas denaske liberaj kaj egalaj laŭ digno kaj rajtoj. Ili posedas racion kaj konsciencon, kaj devus konduti unu al alia en spirito de frateco. la de kaj en al por estas ne kun ke mi vi li ŝi ĝi ni ili tiu kiu sed aŭ pli",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of and to in a is that it was for on as with he she they were his her this have from which but not are at be or an over the other and by had there been who what when where their would about if of the in the",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. el la de que y en un una ser se no haber por con su para como estar tener lo todo pero más hacer poder este otro ese si ya cuando muy los las del al",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. o a de que e em um uma não para com por mais os as do da no na dos das ao são como mas foi ele ela você seu sua quando muito também já está",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. il lo la i gli le di che e in un una è non per con del della dei delle sono come ma più anche questo quello nel nella alla dal si ha",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. le la les de des du un une et est en que qui dans pour pas sur au aux ce cette il elle par avec plus ne se son sa ses mais nous vous comme tout",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am noch wie einem über durch wurde jeder",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой ты от для его через было как так ещё только",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. і в не на я що він з а у це вона як до але вони ми є який із за й від для його про було так ще тільки цей та їх",
    "be": "Усе людзі нараджаюцца свабоднымі і роўнымі ў сваёй годнасці і правах. Яны надзелены розумам і сумленнем і павінны ставіцца адзін да аднаго ў духу брацтва. і ў не на я што ён з а у гэта яна як да але яны мы які за ад для яго пра было так яшчэ толькі гэты або",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. и в не на да от за се че с е са по като това към но те ние който тя той при много също още само този или ще",
    "sr": "Сва људска бића рађају се слободна и једнака у достојанству и правима. Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства. и у је на да се од за не са су као то што али они ми који она он при много још само овај или ће би",
    "mk": "Сите човечки суштества се раѓаат слободни и еднакви по достоинство и права. Тие се обдарени со разум и совест и треба да се однесуваат еден кон друг во духот на општо човечката припадност. и во не на да од за се дека со е се како тоа но тие ние кој таа тој при многу уште само овој или ќе би",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. i w nie na się z do to że jest o jak za po ale przez od są dla czy tak już był była było który która jego jej tym",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. a v se na je že s z to o do ve i pro jako za by ale po který jsem jsou byl být od nebo tak při podle jeho už když",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a svedomím a majú navzájom jednať v bratskom duchu. a v sa na je že s z to o do vo i pre ako za by ale po ktorý som sú bol byť od alebo tak pri podľa jeho už keď",
    "sl": "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. in je v na se da za so z pa ki ne bi tudi po kot ali od bil ni ta pri kar kako še če samo njegov",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. i u je na da se od za ne sa su kao to što ali oni mi koji ona on pri mnogo još samo ovaj ili će bi",
    "nb": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. og i er det på som en for av til å at med ikke den har var jeg om et men fra de hun han seg ble etter når også noe meg",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. og i er det på som en for af til at med ikke den har var jeg om et men fra de hun han sig blev efter når også noget mig hvad",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. och i är det på som en för av till att med inte den har var jag om ett men från de hon han sig blev efter när också något mig vad",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ja on ei se että hän oli olla mutta joka tämä kun niin kuin mitä minä sinä me he ovat myös vain sen jos tai mukaan",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. ja on ei see et ta oli olla aga kes kui nii mis mina sina me nad ka ainult selle või järgi oma pärast",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. a az és hogy nem is egy van volt meg csak ez de ha már vagy mint még azt ki el kell lesz nagyon minden őt akkor",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ve bir bu da de için ile çok daha ne gibi var kadar ama olan olarak sonra ben sen o biz onlar değil mi en her şey",
    "az": "Bütün insanlar ləyaqət və hüquqlarına görə azad və bərabər doğulurlar. Onların şüurları və vicdanları var və bir-birlərinə münasibətdə qardaşlıq ruhunda davranmalıdırlar. və bir bu da də üçün ilə çox daha nə kimi var qədər amma olan sonra mən sən o biz onlar deyil ən hər",
    "uz": "Barcha odamlar erkin, qadr-qimmat va huquqlarda teng bo'lib tug'iladilar. Ular aql va vijdon sohibidirlar va bir-birlari ila birodarlarcha muomala qilishlari zarur. va bir bu da uchun bilan ham ko'p yoki lekin men sen u biz ular emas kerak bo'lgan esa har eng",
    "tk": "Hemme adamlar öz mertebesi we hukuklary boýunça deň ýagdaýda dünýä inýärler. Olara aň hem wyždan berlendir we olar bir-birleri bilen doganlyk ruhundaky gatnaşykda bolmalydyrlar. we bir bu hem üçin bilen köp ýa emma men sen ol biz olar däl gerek bolan her iň",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. de het een van en in is dat op te zijn met voor niet aan er om ook als maar dan bij uit hij zij naar heeft wordt nog door over",
    "af": "Alle menslike wesens word vry, met gelyke waardigheid en regte, gebore. Hulle het rede en gewete en behoort in die gees van broederskap teenoor mekaar op te tree. die van en in is dat op te wees met vir nie aan daar om ook as maar dan by uit hy sy na het word nog deur oor wat sal kan",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. și de în a la cu nu este o un care pe să din mai că pentru se lui ei sunt dar fost acest când sau ale prin",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres. el la de que i en un una és no per amb els les del dels al als però més seva seu aquest quan també ja com fer molt tot hi",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. ir yra ne į kad su tai iš bet buvo būti kaip ar jis ji mes jie už nuo prie labai tik dar šis arba apie po savo kai",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. un ir ne uz ka ar tas no bet bija būt kā vai viņš viņa mēs viņi par pie ļoti tikai vēl šis arī pēc savu kad",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em. và của là có không cho được một các những với trong người này đã để khi tôi anh ở cũng như",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. yang dan di ini dengan untuk tidak dari dalam akan pada itu adalah ke saya juga ada mereka kita bisa oleh atau sudah karena",
    "jv": "Saben uwong kalairake kanthi mardika lan darbe martabat lan hak-hak kang padha. Kabeh pinaringan akal lan kalbu sarta kaajab pasrawungan anggone memitran siji lan sijine kanthi jiwa sumadulur. lan ing sing iki karo kanggo ora saka bakal marang iku yaiku menyang aku uga ana dheweke kita bisa dening utawa wis amarga",
    "tl": "Ang lahat ng tao ay isinilang na malaya at pantay-pantay sa karangalan at mga karapatan. Sila ay pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa't isa sa diwa ng pagkakapatiran. ang ng sa na mga ay at hindi ko siya ito para kung may ako niya pa rin lang kayo nila namin kaya",
    "ak": "Wɔawo adasamma nyinaa sɛ nnipa a wɔwɔ ahofadi. Na wɔn nyinaa yɛ pɛ wɔ nidi ne kyɛfa mu. Wɔwɔ adwene ne ahonim, na ɛsɛ sɛ wobu wɔn ho wɔn ho sɛ anuanom. na ne wɔ sɛ a no mu ho yɛ ɛyɛ ɛno wo me ɔno yɛn nso ara bi",
    "zu": "Bonke abantu bazalwa bekhululekile belingana ngesithunzi nangamalungelo. Bahlanganiswe wumcabango nangunembeza futhi kufanele baphathane ngomoya wobunye. ukuthi futhi kodwa ngoba uma kakhulu yena thina bona lapho kanye ukuze nje manje umuntu abantu into ngesikhathi",
    "sn": "Vanhu vese vanoberekwa vakasununguka uye vakaenzana pahunhu nekodzero dzavo. Vanhu vese vanechipo chokufunga nekuziva chakaipa nechakanaka saka vanofanira kubatana nomweya wehusahwira. uye kuti asi nokuti kana zvakanyanya iye isu ivo apo pamwe munhu vanhu chinhu nguva zvino",
    "la": "Omnes homines liberi aequique dignitate atque iuribus nascuntur. Ratione conscientiaque praediti sunt et alii erga alios cum fraternitate se gerere debent. et in est non ad ut cum sed qui quae quod si ex de ab per sunt esse hoc autem enim nec quam aut atque eius omnia",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. في من على أن إلى عن هذا التي الذي ما لا هو هي كان كل ذلك بين بعد قد مع أو",
    "fa": "تمام افراد بشر آزاد به دنیا می آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان می باشند و باید نسبت به یکدیگر با روح برادری رفتار کنند. و در به از که این است را با برای آن یک خود تا کرد بر هم نیز گفت می شود",
    "ur": "تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔ انہیں ضمیر اور عقل ودیعت ہوئی ہے۔ اس لیے انہیں ایک دوسرے کے ساتھ بھائی چارے کا سلوک کرنا چاہیے۔ کے کی میں ہے اور سے کا کو اس پر یہ نے ایک ہیں وہ بھی نہیں تھا جو",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। के में है की से को का और पर यह ने एक हैं वह भी नहीं था जो",
    "mr": "सर्व मानवी व्यक्ती जन्मतःच स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत. त्यांना विचारशक्ती व सदसद्विवेकबुद्धी लाभलेली आहे व त्यांनी एकमेकांशी बंधुत्वाच्या भावनेने आचरण करावे. आणि आहे हे या ते तो ती मी नाही होते आहेत का पण एक साठी",
    "ne": "सबै व्यक्तिहरू जन्मजात स्वतन्त्र हुन् ती सबैको समान अधिकार र महत्व छ। निजहरूमा विचार शक्ति र सद्विचार भएकोले निजहरूले आपसमा भातृत्वको भावना बाट व्यवहार गर्नु पर्छ। र छ को मा हो ले लाई यो पनि एक छन् थियो गर्न भने तर",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. של את על לא הוא היא זה עם אני גם כי או אבל מה כל יש",
    "yi": "יעדער מענטש ווערט געבוירן פֿרײַ און גלײַך אין כּבֿוד און רעכט. יעדער ווערט באַשאָנקן מיט פֿאַרשטאַנד און געוויסן; יעדער זאָל זיך פֿירן מיט אַ צווייטן אין אַ געמיט פֿון ברודערשאַפֿט. און די דער איז אין פון מיט נישט אויף דאס האט צו",
}
