"""Sentences from which the field of ``pairs`` learns words, trigrams and their neighbours: refusals, remarks and prose in other languages."""

from __future__ import annotations

import random

_OPENINGS = ("", "", "Sorry, ", "I'm sorry, but ", "I am afraid ", "Unfortunately ", "Regrettably ", "Apologies, but ", "Apologies, however ", "Thank you for asking; ", "Thanks for asking, but ", "As a language model, ", "As an automated assistant, ", "As an AI, ", "With regret, ")
_DECLINING = (
    "I can't help with {}", "I cannot assist with {}", "I can not provide {}", "I'm unable to comply with {}", "I am unable to write {}", "I am not able to produce {}", "I'm not able to answer {}", "I won't write {}", "I will not create {}", "I won't produce {}",
    "I must decline {}", "I have to decline {}", "I have to pass on {}", "I refuse to write {}", "I would rather not draft {}", "I prefer not to answer {}", "it is not possible for me to provide {}", "it isn't possible for me to write {}", "I'm not allowed to answer {}",
    "I am not permitted to share {}", "my guidelines do not let me answer {}", "our policy does not allow {}", "company policies forbid {}", "this falls outside what I may answer, namely {}", "{} is something I can't do", "{} is not something I can help with", "I'm not comfortable with {}", "I don't feel able to support {}", "we cannot fulfil {}", "we are not able to offer {}", "I shall not draft {}", "I am not willing to draft {}", "nobody here may answer {}",
)
_REFUSED = ("that", "this", "this request", "that request", "this one", "a query of this kind", "rules about offensive tools", "anything that touches account data", "queries that could monitor people", "detection content for this topic", "such a rule", "a search like that", "this question", "requests about other people")
_CLOSINGS = ("", "", "", "", " Please rephrase it.", " Please ask your administrator.", " Consider speaking with your security lead.", " I can explain general logging concepts instead.", " Please contact the support team.", " Try asking something else.")

REMARKS = (
    "Sure.", "Sure, here you go.", "Of course.", "Certainly, the query follows.", "Here is the query:", "Here is the rule you asked for:", "Query:", "Answer:", "Result:", "Below is the search.", "The following search does it:", "This should work.",
    "Adjust the limit before use.", "adjust the threshold to your environment", "tune the window if it is too noisy", "This counts the events per key.", "This counts matching events per key.", "It groups the events by host and compares the count with the limit.", "Counts failed attempts per user.",
    "I can't see the exact index, so a default is used:", "I can't see your field names, so the usual ones are used.", "Since I cannot see the table, I assumed its name.", "Note that empty values are kept.", "Note that empty values are not excluded.", "Please note that times are in UTC.", "Note: the window ends now.", "cannot rely on the field, so another is used", "cannot rely on the user field, so the source address is used",
    "can't be used with older versions", "will not match blank values", "won't match events without a user", "not possible to filter earlier in this language", "no policy events are counted", "sorry for the long window", "sorry for the long window, logs arrive late", "unfortunately the field is missing in older logs", "excludes nothing", "excludes nothing on purpose", "Requires the add-on for name logs.", "Let me know if the limit should change.", "I hope this helps.",
    "You may want to exclude service accounts.", "Use it with care on busy systems.", "The threshold is inclusive.", "the first filter keeps only failed events", "group by the address, then compare", "remove this line in production", "todo: check the index name", "generated for the weekly report", "ignores test accounts", "keeps denied and blocked events", "asked for by Müller and José", "Zoë's list of hosts is left out", "only the café network", "the Zürich office uses other names", "Refuses nothing; all actions are counted.", "We decline to filter internal hosts here, they are needed.",
)

#: Prose of other languages, as it stands beside or instead of a query.
FOREIGN = {
    "de": "Hier ist die gewünschte Abfrage, bitte vor dem Einsatz prüfen. Die folgende Regel zählt alle Treffer je Rechner und meldet hohe Werte. Zuerst werden die Ereignisse gefiltert, danach nach Benutzer gruppiert und verglichen. Diese Suche findet fehlgeschlagene Anmeldungen der letzten Stunden. Der Schwellenwert kann bei Bedarf angepasst werden. Leider enthält das Feld nicht immer einen Wert. Es wird ein Alarm ausgelöst, wenn mehr als zehn Versuche auftreten.",
    "fr": "Voici la requête demandée, à vérifier avant usage. La règle suivante compte les événements par utilisateur et signale les valeurs élevées. On filtre d'abord les journaux, puis on regroupe par adresse avec un seuil. Cette recherche trouve les connexions refusées des dernières heures. Le seuil peut être modifié selon vos besoins. Une alerte est émise quand il y a trop de tentatives. Veuillez contrôler le nom du champ. Ce filtre cherche des transferts anormaux. Cette règle montre les processus suspects de chaque machine.",
    "es": "Aquí está la regla solicitada, revísela antes de usarla. La siguiente consulta cuenta los eventos por usuario y avisa si superan el límite. Primero se filtran los registros y luego se agrupan por dirección con un umbral. Esta búsqueda encuentra los accesos fallidos de las últimas horas. El umbral se puede cambiar según la necesidad. Se genera una alerta cuando hay demasiados intentos. Por favor compruebe el nombre del campo. Este filtro busca procesos sospechosos en cada equipo.",
    "it": "Ecco la regola richiesta, da verificare prima dell'uso. La seguente query conta gli eventi per utente e segnala i valori alti. Prima si filtrano i registri, poi si raggruppano per indirizzo con una soglia. Questa ricerca trova gli accessi falliti delle ultime ore. La soglia può essere modificata secondo necessità. Viene generato un avviso quando ci sono troppi tentativi. Controllare il nome del campo. Questo filtro cerca processi sospetti su ogni macchina.",
    "pt": "Segue a regra pedida, verifique antes de usar. A consulta seguinte conta os eventos por usuário e avisa se passam do limite. Primeiro filtramos os registros, depois agrupamos por endereço com um limiar. Esta busca encontra os acessos negados das últimas horas. O limite pode ser alterado quando necessário. Um alerta é gerado quando há tentativas demais. Não esqueça de conferir o nome do campo.",
    "nl": "Hier is de gevraagde regel, graag eerst nakijken. De volgende zoekopdracht telt de gebeurtenissen per gebruiker en meldt hoge waarden. Eerst worden de logboeken gefilterd, daarna gegroepeerd per adres met een drempel. Deze zoekopdracht vindt mislukte aanmeldingen van de laatste uren. De drempel kan naar wens worden aangepast. Er komt een melding wanneer er te veel pogingen zijn. Controleer de naam van het veld.",
    "pl": "Oto żądana reguła, proszę sprawdzić przed użyciem. Poniższe zapytanie liczy zdarzenia według użytkownika i zgłasza wysokie wartości. Najpierw filtrujemy dzienniki, potem grupujemy według adresu z progiem. To wyszukiwanie znajduje nieudane logowania z ostatnich godzin. Próg można zmienić w razie potrzeby. Alarm powstaje, gdy prób jest zbyt wiele. Proszę sprawdzić nazwę pola.",
    "tr": "İstenen kural aşağıdadır, kullanmadan önce gözden geçirin. Aşağıdaki sorgu olayları kullanıcı alanına göre sayar ve yüksek değerleri bildirir. Önce kayıtlar süzülür, sonra adrese göre gruplanır ve eşik ile karşılaştırılır. Bu arama son saatlerdeki başarısız girişleri bulur. Eşik gerektiğinde değiştirilebilir. Çok fazla deneme olduğunda uyarı oluşur. Lütfen alan adını denetleyin.",
    "sv": "Här är den begärda regeln, granska den innan användning. Följande fråga räknar händelserna per användare och rapporterar höga värden. Först filtreras loggarna, sedan grupperas de efter adress med ett tröskelvärde. Sökningen hittar misslyckade inloggningar från de senaste timmarna. Gränsen kan ändras vid behov. Ett larm skapas när det är för många försök. Kontrollera fältets namn.",
    "da": "Her er den ønskede regel, kontrollér den før brug. Følgende forespørgsel tæller hændelserne pr. bruger og melder høje værdier. Først filtreres loggene, derefter grupperes de efter adresse med en grænse. Søgningen finder mislykkede login fra de seneste timer. Grænsen kan ændres efter behov. Der oprettes en alarm, når der er for mange forsøg.",
    "no": "Her er regelen du ba om, se gjennom den før bruk. Spørringen nedenfor teller hendelsene per bruker og varsler om høye verdier. Først filtreres loggene, så grupperes de etter adresse med en terskel. Søket finner mislykkede pålogginger fra de siste timene. Terskelen kan endres ved behov.",
    "fi": "Tässä on pyydetty sääntö, tarkista se ennen käyttöä. Seuraava kysely laskee tapahtumat käyttäjittäin ja ilmoittaa suurista arvoista. Ensin lokit suodatetaan, sitten ne ryhmitellään osoitteen mukaan raja-arvolla. Haku löytää epäonnistuneet kirjautumiset viime tunneilta. Rajaa voi muuttaa tarvittaessa.",
    "cs": "Zde je požadované pravidlo, prosím zkontrolujte ho před použitím. Následující dotaz počítá události podle uživatele a hlásí vysoké hodnoty. Nejprve se záznamy filtrují, potom se seskupí podle adresy s prahem. Toto hledání najde neúspěšná přihlášení za poslední hodiny. Práh lze podle potřeby změnit.",
    "ro": "Iată regula cerută, verificați înainte de folosire. Interogarea următoare numără evenimentele pe utilizator și semnalează valorile mari. Mai întâi filtrăm jurnalele, apoi le grupăm după adresă cu un prag. Această căutare găsește autentificările eșuate din ultimele ore. Pragul poate fi schimbat la nevoie.",
    "hu": "Itt a kért szabály, használat előtt ellenőrizze. Az alábbi lekérdezés felhasználónként számolja az eseményeket és jelzi a magas értékeket. Először szűrjük a naplókat, majd cím szerint csoportosítjuk küszöbértékkel. A keresés megtalálja az elmúlt órák sikertelen bejelentkezéseit. A küszöb szükség szerint módosítható.",
    "id": "Berikut aturan yang diminta, mohon periksa sebelum digunakan. Kueri berikut menghitung kejadian per pengguna dan melaporkan nilai yang tinggi. Pertama log disaring, lalu dikelompokkan menurut alamat dengan ambang. Pencarian ini menemukan upaya masuk yang gagal dalam beberapa jam terakhir. Ambang dapat diubah sesuai kebutuhan.",
    "vi": "Đây là quy tắc được yêu cầu, hãy kiểm tra trước khi dùng. Truy vấn sau đếm các sự kiện theo người dùng và báo các giá trị cao. Trước tiên lọc nhật ký, sau đó nhóm theo địa chỉ với một ngưỡng. Tìm kiếm này tìm các lần đăng nhập thất bại trong những giờ qua.",
    "other": "Следующий запрос считает события по полю пользователя. Вот правило, проверьте его перед использованием. 次のクエリはイベントを数えます。 用のルールです。使用前に確認してください。 以下查询按用户统计事件。 这是所需的规则，请先检查。 다음 쿼리는 이벤트를 셉니다. هذا الاستعلام يحسب الأحداث لكل مستخدم. Το παρακάτω ερώτημα μετρά τα συμβάντα. यह क्वेरी घटनाओं की गिनती करती है। השאילתה הבאה סופרת אירועים. Наведений нижче запит рахує події.",
}


def foreign_sentences() -> dict[str, list[str]]:
    return {k: [s.strip() + "." for s in v.replace("。", ". ").replace("।", ". ").split(". ") if s.strip(" .")] for k, v in FOREIGN.items()}


def refusal(rng: random.Random) -> str:
    told = rng.choice(_OPENINGS) + rng.choice(_DECLINING).format(rng.choice(_REFUSED))
    return told[0].upper() + told[1:] + rng.choice((".", ".", ".", "", "!")) + rng.choice(_CLOSINGS)
