"""Telling languages from one another by character n-grams.

The model is fitted on a paragraph in each language and then learns the words of the table's own texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.functions.words import SEPARATORS, mix

#: Buckets of the character n-grams, as a power of two.
LANG_BITS = 15
#: Words from which on a text of the table is learned from.
LONG = 30
#: The share that an unseen n-gram is taken to have.
UNSEEN = 1e-5
SEED_SPLIT = r"[\W\d_]+"

# The same matter told in many languages; written for this purpose.
SEED_TEXTS = {
    "en": "The team has checked all of the records and there is nothing that would explain why this host was not updated before the end of the day. They should ask whether it could be moved, because it will have been used by other people, and then write what they know about each of these cases. How did you find out which one is right, and what can we do with our own data if it does not work? Please tell me where the first alert came from, how many users were affected and who is to look after it now.",
    "de": "Das Team hat alle Aufzeichnungen geprüft und es gibt nichts, was erklären würde, warum dieser Rechner nicht vor dem Ende des Tages aktualisiert wurde. Sie sollten fragen, ob er verschoben werden kann, weil er auch von anderen Leuten benutzt worden ist, und dann schreiben, was sie über jeden dieser Fälle wissen. Wie haben Sie herausgefunden, welche Antwort richtig ist, und was können wir mit unseren eigenen Daten tun, wenn es nicht geht? Bitte sagen Sie mir, woher die erste Warnung kam und wer sich jetzt darum kümmert.",
    "fr": "L'équipe a vérifié tous les enregistrements et il n'y a rien qui puisse expliquer pourquoi cette machine n'a pas été mise à jour avant la fin de la journée. Ils devraient demander si elle peut être déplacée, parce qu'elle a aussi été utilisée par d'autres personnes, puis écrire ce qu'ils savent sur chacun de ces cas. Comment avez-vous trouvé laquelle est juste, et que pouvons-nous faire avec nos propres données si cela ne marche pas ? Dites-moi d'où vient la première alerte et qui doit s'en occuper maintenant.",
    "es": "El equipo ha revisado todos los registros y no hay nada que explique por qué esta máquina no fue actualizada antes del final del día. Deberían preguntar si se puede mover, porque también ha sido usada por otras personas, y luego escribir lo que saben sobre cada uno de estos casos. ¿Cómo supieron cuál es la correcta y qué podemos hacer con nuestros propios datos si no funciona? Por favor, dígame de dónde vino la primera alerta y quién debe ocuparse de ella ahora.",
    "it": "La squadra ha controllato tutti i registri e non c'è niente che possa spiegare perché questa macchina non è stata aggiornata prima della fine della giornata. Dovrebbero chiedere se può essere spostata, perché è stata usata anche da altre persone, e poi scrivere quello che sanno di ciascuno di questi casi. Come avete trovato quale sia giusta, e che cosa possiamo fare con i nostri dati se non funziona? Ditemi da dove è venuto il primo avviso e chi deve occuparsene adesso. Durante la notte è arrivato alla rete più traffico del solito e abbiamo visto che diversi account erano bloccati. Controllate i log prima di chiudere il caso e verificate che non ci sia dietro un programma noto. Nessun dato è stato salvato, quindi la domanda resta aperta.",
    "pt": "A equipe verificou todos os registros e não há nada que explique por que esta máquina não foi atualizada antes do fim do dia. Eles deveriam perguntar se ela pode ser movida, porque também foi usada por outras pessoas, e depois escrever o que sabem sobre cada um desses casos. Como vocês descobriram qual é a certa, e o que podemos fazer com os nossos próprios dados se isso não funcionar? Por favor, diga de onde veio o primeiro alerta e quem deve cuidar dele agora. Durante a noite chegou à rede mais tráfego do que o normal e vimos que várias contas estavam bloqueadas. Revejam os registros antes de fechar o caso e verifiquem se não há um programa conhecido por trás. Nenhum dado foi guardado, então a questão continua aberta.",
    "nl": "Het team heeft alle gegevens bekeken en er is niets dat zou verklaren waarom deze machine niet voor het einde van de dag is bijgewerkt. Zij moeten vragen of hij verplaatst kan worden, omdat hij ook door andere mensen gebruikt wordt, en daarna schrijven wat ze over elk van deze gevallen weten. Hoe hebben jullie gevonden welke juist is, en wat kunnen wij met onze eigen gegevens doen als het niet werkt? Zeg mij waar de eerste melding vandaan kwam en wie er nu voor moet zorgen. In de nacht kwam er meer verkeer op het netwerk dan gewoonlijk, en we zagen dat enkele accounts waren vergrendeld. Bekijk de logboeken voordat u de zaak sluit en ga na of er geen bekend programma achter zit. Er zijn geen gegevens bewaard, dus de vraag blijft open.",
    "pl": "Zespół sprawdził wszystkie zapisy i nie ma niczego, co by wyjaśniało, dlaczego ten komputer nie został zaktualizowany przed końcem dnia. Powinni zapytać, czy można go przenieść, ponieważ był używany także przez inne osoby, a potem napisać, co wiedzą o każdym z tych przypadków. Jak znaleźliście, która odpowiedź jest właściwa, i co możemy zrobić z naszymi danymi, jeśli to nie działa? Proszę powiedzieć, skąd przyszło pierwsze ostrzeżenie i kto ma się tym teraz zająć. Serwer wysłał wiele pakietów, a analitycy już je badają. W nocy do sieci dotarło więcej ruchu niż zwykle i zauważyliśmy, że kilka kont było zablokowanych. Przejrzyjcie dzienniki przed zamknięciem sprawy i sprawdźcie, czy nie stoi za tym znany program. Nie zapisano żadnych danych, więc pytanie pozostaje otwarte.",
    "cs": "Tým zkontroloval všechny záznamy a není nic, co by vysvětlovalo, proč tento počítač nebyl aktualizován před koncem dne. Měli by se zeptat, zda je možné ho přesunout, protože ho používali také jiní lidé, a potom napsat, co vědí o každém z těchto případů. Jak jste zjistili, která odpověď je správná, a co můžeme dělat s našimi daty, když to nefunguje? Řekněte mi prosím, odkud přišlo první varování a kdo se o to teď stará. V noci přišlo do sítě více provozu než obvykle a viděli jsme, že několik účtů bylo zamčeno. Projděte záznamy, než případ uzavřete, a ověřte, zda za tím není známý program. Žádná data se neuložila, takže otázka zůstává otevřená.",
    "hr": "Tim je provjerio sve zapise i nema ničega što bi objasnilo zašto ovo računalo nije ažurirano prije kraja dana. Trebali bi pitati može li se premjestiti, jer su ga koristili i drugi ljudi, a zatim napisati što znaju o svakom od ovih slučajeva. Kako ste pronašli koji je odgovor točan i što možemo učiniti s našim podacima ako to ne radi? Recite mi odakle je došlo prvo upozorenje i tko se sada time bavi. Noću je u mrežu stiglo više prometa nego obično i vidjeli smo da je nekoliko računa zaključano. Analitičari su pregledali dnevnike i povezali ih s poznatim programom. Podaci nisu sačuvani, pa pitanje ostaje otvoreno. Poslužitelj je poslao mnogo paketa.",
    "sv": "Gruppen har kontrollerat alla uppgifter och det finns inget som skulle förklara varför den här datorn inte blev uppdaterad före dagens slut. De borde fråga om den kan flyttas, eftersom den också har använts av andra människor, och sedan skriva vad de vet om vart och ett av dessa fall. Hur hittade ni vilket som är rätt, och vad kan vi göra med våra egna data om det inte fungerar? Var snäll och säg mig varifrån den första varningen kom och vem som ska ta hand om den nu. Servern skickade många paket till värden innan natten var över. Under natten kom det mer trafik till nätet än vanligt, och vi såg att flera konton hade låsts. Granska loggarna innan ni stänger ärendet, och kontrollera att ett känt program inte ligger bakom. Ingen data sparades, så frågan är fortfarande öppen.",
    "da": "Holdet har kontrolleret alle oplysninger, og der er ikke noget, som ville forklare, hvorfor denne maskine ikke blev opdateret før dagens slutning. De burde spørge, om den kan flyttes, fordi den også er blevet brugt af andre mennesker, og så skrive, hvad de ved om hver af disse sager. Hvordan fandt I ud af, hvilken der er rigtig, og hvad kan vi gøre med vores egne data, hvis det ikke virker? Sig mig venligst, hvor den første advarsel kom fra, og hvem der nu skal tage sig af den. I løbet af natten kom der mere trafik til nettet end normalt, og vi så, at flere konti var låst. Gennemgå logfilerne, før I lukker sagen, og kontroller, at et kendt program ikke står bag. Ingen data blev gemt, så spørgsmålet er stadig åbent.",
    "fi": "Ryhmä on tarkistanut kaikki tiedot, eikä mikään selitä, miksi tätä konetta ei päivitetty ennen päivän loppua. Heidän pitäisi kysyä, voidaanko se siirtää, koska myös muut ihmiset ovat käyttäneet sitä, ja sitten kirjoittaa, mitä he tietävät jokaisesta näistä tapauksista. Miten löysitte oikean vastauksen, ja mitä voimme tehdä omilla tiedoillamme, jos se ei toimi? Kertokaa minulle, mistä ensimmäinen varoitus tuli ja kuka siitä nyt huolehtii. Yöllä verkkoon tuli tavallista enemmän liikennettä, ja näimme, että useita tilejä oli lukittu. Tarkistakaa lokit ennen kuin suljette tapauksen. Mitään tietoja ei tallennettu, joten kysymys on yhä auki.",
    "hu": "A csapat minden feljegyzést ellenőrzött, és semmi sincs, ami megmagyarázná, miért nem frissítették ezt a gépet a nap vége előtt. Meg kellene kérdezniük, hogy át lehet-e helyezni, mert más emberek is használták, és aztán le kell írniuk, mit tudnak ezekről az esetekről. Hogyan találtátok meg, melyik a helyes, és mit tehetünk a saját adatainkkal, ha nem működik? Kérem, mondja meg, honnan jött az első riasztás, és ki foglalkozik vele most. Éjszaka a szokásosnál több forgalom érkezett a hálózatra, és láttuk, hogy több fiók zárolva volt. Nézzétek át a naplókat, mielőtt lezárjátok az ügyet. Nem maradtak meg adatok, ezért a kérdés nyitott.",
    "tr": "Ekip bütün kayıtları kontrol etti ve bu makinenin neden gün sonundan önce güncellenmediğini açıklayacak hiçbir şey yok. Başka insanlar tarafından da kullanıldığı için taşınıp taşınamayacağını sormalı ve sonra bu olayların her biri hakkında ne bildiklerini yazmalılar. Hangisinin doğru olduğunu nasıl buldunuz ve çalışmazsa kendi verilerimizle ne yapabiliriz? Lütfen bana ilk uyarının nereden geldiğini ve şimdi onunla kimin ilgileneceğini söyleyin. Sunucu çok sayıda paket gönderdi ve analistler bunları inceliyor. Gece ağa her zamankinden daha fazla trafik geldi ve birkaç hesabın kilitlendiğini gördük. Dosyayı kapatmadan önce kayıtları inceleyin ve arkasında bilinen bir program olup olmadığına bakın. Hiç veri saklanmadı, bu yüzden soru hâlâ açık.",
    "ro": "Echipa a verificat toate înregistrările și nu există nimic care să explice de ce această mașină nu a fost actualizată înainte de sfârșitul zilei. Ar trebui să întrebe dacă poate fi mutată, pentru că a fost folosită și de alți oameni, apoi să scrie ce știu despre fiecare dintre aceste cazuri. Cum ați aflat care este corectă și ce putem face cu datele noastre dacă nu merge? Vă rog să-mi spuneți de unde a venit prima alertă și cine se ocupă acum de ea. În timpul nopții a ajuns în rețea mai mult trafic decât de obicei și am văzut că mai multe conturi erau blocate. Verificați jurnalele înainte de a închide cazul. Nu s-au păstrat date, așa că întrebarea rămâne deschisă.",
    "id": "Tim sudah memeriksa semua catatan dan tidak ada yang dapat menjelaskan mengapa mesin ini tidak diperbarui sebelum akhir hari. Mereka harus bertanya apakah mesin itu bisa dipindahkan, karena juga telah digunakan oleh orang lain, lalu menulis apa yang mereka ketahui tentang setiap kasus ini. Bagaimana kalian menemukan mana yang benar, dan apa yang dapat kami lakukan dengan data kami sendiri jika tidak berhasil? Tolong katakan dari mana peringatan pertama datang dan siapa yang mengurusnya sekarang.",
    "vi": "Nhóm đã kiểm tra tất cả các bản ghi và không có gì giải thích tại sao máy này không được cập nhật trước khi hết ngày. Họ nên hỏi xem có thể di chuyển nó không, vì nó cũng đã được những người khác sử dụng, rồi viết những gì họ biết về từng trường hợp này. Làm thế nào các bạn biết cái nào đúng, và chúng tôi có thể làm gì với dữ liệu của mình nếu nó không hoạt động? Xin cho tôi biết cảnh báo đầu tiên đến từ đâu và ai đang lo việc đó.",
    "ru": "Команда проверила все записи, и нет ничего, что объяснило бы, почему эта машина не была обновлена до конца дня. Им следует спросить, можно ли её перенести, потому что ею пользовались и другие люди, а затем написать, что они знают о каждом из этих случаев. Как вы узнали, какой ответ верный, и что мы можем сделать с нашими данными, если это не работает? Скажите, откуда пришло первое предупреждение и кто теперь за него отвечает.",
    "uk": "Команда перевірила всі записи, і немає нічого, що пояснило б, чому ця машина не була оновлена до кінця дня. Їм слід запитати, чи можна її перенести, тому що нею користувалися й інші люди, а потім написати, що вони знають про кожен із цих випадків. Як ви дізналися, яка відповідь правильна, і що ми можемо зробити з нашими даними, якщо це не працює? Скажіть, звідки надійшло перше попередження і хто тепер за нього відповідає.",
    "el": "Η ομάδα έλεγξε όλες τις εγγραφές και δεν υπάρχει τίποτα που να εξηγεί γιατί αυτό το μηχάνημα δεν ενημερώθηκε πριν από το τέλος της ημέρας. Θα έπρεπε να ρωτήσουν αν μπορεί να μεταφερθεί, επειδή το χρησιμοποίησαν και άλλοι, και μετά να γράψουν τι ξέρουν για κάθε μία από αυτές τις περιπτώσεις. Πείτε μου από πού ήρθε η πρώτη προειδοποίηση και ποιος τη φροντίζει τώρα.",
    "ar": "راجع الفريق جميع السجلات ولا يوجد ما يفسر لماذا لم يتم تحديث هذا الجهاز قبل نهاية اليوم. يجب أن يسألوا هل يمكن نقله لأنه استخدم أيضا من قبل أشخاص آخرين ثم يكتبوا ما يعرفونه عن كل حالة من هذه الحالات. من فضلك قل لي من أين جاء التحذير الأول ومن الذي يهتم به الآن وماذا يمكن أن نفعل إذا لم ينجح ذلك.",
    "zh": "团队 检查 了 所有 的 记录 没有 什么 可以 说明 为什么 这 台 主机 没有 在 今天 结束 之前 更新 他们 应该 问 是否 可以 移动 因为 它 也 被 其他 人 使用 过 然后 写 下 他们 知道 的 每 一 个 情况 请 告诉 我 第一 个 警报 从 哪里 来 现在 由 谁 负责 如果 不 行 我们 能 用 自己 的 数据 做 什么",
    "ja": "チーム は すべて の 記録 を 確認 しました が この 機械 が なぜ 今日 の 終わり まで に 更新 されなかった の か を 説明 する もの は ありません ほか の 人 も 使って いた ので 移動 できる か どうか を 聞いて から それぞれ の 場合 に ついて 知って いる こと を 書いて ください 最初 の 警告 は どこ から 来ました か",
    "ko": "팀은 모든 기록을 확인했지만 이 기계가 왜 하루가 끝나기 전에 업데이트되지 않았는지 설명할 수 있는 것은 없습니다. 다른 사람들도 사용했기 때문에 옮길 수 있는지 물어보고 각 경우에 대해 아는 것을 써야 합니다. 첫 번째 경고가 어디에서 왔는지 그리고 지금 누가 맡고 있는지 말해 주세요.",
}


def hashed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"))


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of each word, offsets by text, the word of each code); words are in lower case."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), []
    clean = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
    lists = pc.split_pattern_regex(pc.utf8_lower(pa.array(clean, pa.large_string())), pattern=SEPARATORS)
    coded = lists.values.dictionary_encode()
    entries = coded.dictionary.to_pylist()
    codes = np.asarray(coded.indices).astype(np.int64)
    real = np.array([x != "" for x in entries], bool)[codes] if len(codes) else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(real)])
    return codes[real], upto[np.asarray(lists.offsets)], entries


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (a row for each word) by text."""
    out = np.zeros((len(offsets) - 1, values.shape[1]), np.float32)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, offsets[some], 0)
    return out


def _word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the character n-grams of all words, offsets by word); words with digits have none."""
    around = ["" if not w or any(c.isdigit() for c in w) else f"^{w[:40]}$" for w in words]
    size = np.array([len(w) for w in around], np.int64)
    chars = np.frombuffer("".join(around).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    rec = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)[rec] if len(rec) else rec
    at = np.arange(len(chars))
    found, own = [], []
    roll = np.zeros(len(chars), np.uint64)
    for k in range(4):
        roll[: len(chars) - k] = mix(roll[: len(chars) - k] * np.uint64(3) + chars[k:] + np.uint64(k + 1))
        ok = at + k < ends
        found.append(roll[ok])
        own.append(rec[ok])
    some = np.flatnonzero(size > 0)
    if len(some):  # the word itself, twice, and its characters' blocks
        whole = np.add.reduceat(mix(chars + (at - (ends - size[rec])).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), (np.cumsum(size) - size)[some])
        far = chars > 0x24F
        found += [whole, whole, mix((chars[far] >> np.uint64(7)) + np.uint64(1 << 40))]
        own += [some, some, rec[far]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    flat, rec = (np.concatenate(found) >> np.uint64(64 - LANG_BITS)).astype(np.int64), np.concatenate(own)
    order = np.argsort(rec, kind="stable")
    return flat[order], np.searchsorted(rec[order], np.arange(len(words) + 1))


class Languages:
    """Which language a word speaks for, by its character n-grams.

    Fitted on SEED_TEXTS and then on the longer texts of the table, as far as they are read with confidence, whose
    words are so learned too, with those of ``asked``, the question of each text.  What speaks for a language is a
    sum over words, each limited, so that names and terms do not decide.  ``prior`` is how often texts of the table
    are in each language.
    """

    def __init__(self, texts: list[str] = (), asked: list[str] = (), rounds: int = 2) -> None:
        self.names = list(SEED_TEXTS)
        seeds = np.zeros((1 << LANG_BITS, len(self.names)))
        for k, name in enumerate(self.names):
            np.add.at(seeds[:, k], _word_grams(re.split(SEED_SPLIT, SEED_TEXTS[name].lower()))[0], 1.0)
        self.prior = np.zeros(len(self.names))
        self._learn(seeds)
        codes, offsets, entries = split_words([*texts, *asked])
        size = np.diff(offsets)
        many = len(texts)
        if not (size >= LONG).any():
            return
        flat, upto = _word_grams(entries)
        for _ in range(rounds):
            own = self.scores(codes, offsets, entries)
            top = np.sort(own, 1)
            sure = (top[:, -1] - top[:, -2] > 8) & (size >= LONG)
            speaks = own.argmax(1)
            if asked:  # a question is learned with its answer, if both are read as the same language
                sure[:many] &= speaks[:many] == speaks[many:]
                sure[many:] = sure[:many]
            counts = seeds.copy()
            for k in range(len(self.names)):
                n = np.bincount(codes[np.repeat(sure & (speaks == k), size)], minlength=len(entries))
                np.add.at(counts[:, k], flat, np.repeat(np.sqrt(n), np.diff(upto)))
            self.prior = np.log((np.bincount(speaks[sure], minlength=len(self.names)) + 1) / (sure.sum() + len(self.names)))
            self._learn(counts)

    def _learn(self, counts: np.ndarray) -> None:
        # unseen n-grams speak for no language, however much of it was read
        self.table = np.log(counts / counts.sum(0) + UNSEEN).astype(np.float32)
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        """Without the words seen so far, which only save time."""
        return self.__dict__ | {"_known": {}}

    def _of_words(self, words: list[str]) -> np.ndarray:
        """What speaks for each language, by word."""
        flat, upto = _word_grams(words)
        z = _sums(self.table[flat], upto)
        p = np.exp(z - z.max(1, keepdims=True))
        out = np.log(0.03 + p / p.sum(1, keepdims=True))
        weight = [1.0 if w.isascii() or ord(w[0]) < 0x2E80 else max(1.0, len(w) / 2) for w in words]
        return np.where((np.diff(upto) > 0)[:, None], out * np.array(weight)[:, None], 0).astype(np.float32)

    def scores(self, codes: np.ndarray, offsets: np.ndarray, entries: list[str]) -> np.ndarray:
        """What speaks for each language, by text; equal for texts without a word."""
        if len(self._known) > 300_000:
            self._known.clear()
        new = [w for w in entries if w and w not in self._known]
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self._known.update(zip(part, self._of_words(part)))
        none = np.zeros(len(self.names), np.float32)
        rows = np.stack([self._known.get(w, none) for w in entries]) if entries else none[None]
        return _sums(rows[codes], offsets)


def _share(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def other_language(said: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """From 0 to 1, how surely texts (rows of language scores) are not in the languages of their questions."""
    q = _share(asked)
    z = said - said.max(1, keepdims=True)
    own = np.log((q * np.exp(z)).sum(1) + 1e-30)
    other = (np.log(1 - q + 1e-12) + z).max(1)
    return 1 / (1 + np.exp(-np.clip(other - own - 4, -30, 30)))
