"""Transliteration families of names: a canonical form and its variants. Order matters: the last entry wins a variant."""

FAMILIES = """Muhammad: Muhammad Mohammed Mohammad Mohamed Mohamad Mohammedh Muhamad Muhammed Mouhamed Muhamed Mohamud Maxamed Mahamed Muhammet Mehmed Mehmet Mahommed Mohamedou Muhammadu
Abdullah: Abdullah Abdallah Abdellah Abdalla Abdulla Abdoulah Abduallah Abdulah Abdullaah
Abdul: Abdul Abdel Abdal Abdu Abdo Abdoul Abd
Ali: Ali Aly Aliy Alee Aali Aalee
Hassan: Hassan Hasan Hasen Hassin Hazan Hussan Hussen Hussein Husein Husayn Houssain Hussain Hussien Hessan Hassane
Ibrahim: Ibrahim Ibraheem Brahim Ebrahim Abrahim Ebraheem Ibraahim Ibrahima
Omar: Omar Umar Omer Oumar Amr Amar Omr Omari
Ahmad: Ahmad Ahmed Ahmet Ahamed Ahmod Ahmmad Achmad Akhmed Ahmadu Ahmedou
Yusuf: Yusuf Yousuf Yousef Yusef Youssef Yosef Yousouf Youssuf Yusouf
Khalid: Khalid Khaled Halid Halide Xaaliid Kalid Khaalid Haaled
Saleh: Saleh Salih Salahuddin Sali Saaleh Saalih Salihu
Mustafa: Mustafa Mustaffa Mustaphar Moustafa Moustaphar Mustafe Mustapha Mustafaa
Ismail: Ismail Ismaeel Ismaiel Ismael Esmail Esmaiel Ismaila Ismailo
Samir: Samir Sameer Samer Samear Saamir Saameir
Tariq: Tariq Tarik Tareck Tarek Taarik
Bashir: Bashir Basheer Beshir Besheer Besher Baashir
Nasir: Nasir Nasser Nasr Naseer Naser Nassir Naasir Nasseer
Rahim: Rahim Raheem Rahman Abdirahman Abdurahman Abdurrahman Raahim
Idris: Idris Idriss Edriss Edris Iidriis Idrees
Hamid: Hamid Hameed Hamede Hamiid Hamide
Jamal: Jamal Gamal Djamal Cemal Camal Djamaal Jamaal Jemaal
Kareem: Kareem Karim Karem Kerim Kariim Kaareem
Mahdi: Mahdi Mehdi Mehdee Mahdee Mahdii Mehdii
Rashid: Rashid Rasheed Rasheid Rasid Raashid Rasheide
Suleiman: Suleiman Suleyman Soliman Sulayman Suleman Suliman Suleimaan Souleymane Souleiman
Asad: Asad Assad Asaad Assaad Assade
Osman: Osman Usman Othman Uthman Ousman Usmann Osmann
Elias: Elias Ilyas Iliyas Eliyas Ilias Ilyaas Eliasse
Dawit: Dawit Dawood Daud Daowd Daawit Dawud
Aisha: Aisha Ayesha Aysha Aiesha Isha Iisha Aaisha Ayisha Aishat Aicha Aïcha Aesha Aeisha
Fatima: Fatima Fatimah Fathima Fatma Fatume Fadumo Faatima Fatimeh Fatiha Fatimat Fatouma Fatou Fatoumata Fatoumah
Maryam: Maryam Mariam Maryem Meriam Miriam Marem Maariam Maryame Mariama Mariyama
Amina: Amina Aminah Aamina Amena Amyna Aminata Ameena Amynat
Zainab: Zainab Zaynab Zineb Zenab Zeynep Zaenab Zaienab Zeinab Zaineb Zeineb
Khadija: Khadija Khadijah Khadidja Khadeeja Kadidia Kadidja Khadijeh Hadidjah Hadija Hadidja
Noor: Noor Nur Nour Noura Nura Noure Nuura Nuuraa
Yusra: Yusra Yousra Yusraa Yousraa Yosra
Rahel: Rahel Rachel Rakel Raheil Raakel
Habiba: Habiba Habiiba Habeeba Habibah Habibata Habibo Habiibo
Saada: Saada Saado Saade Saadiya Saadia
Hodan: Hodan Hodon Hodhan Hoodaan
Safiya: Safiya Safia Safiyya Safiyah Sofi Sofiyah Safiyyah
Halima: Halima Haleema Halimah Haliima Halimata Halimeh Halimat
Leila: Leila Layla Lila Laila Leyla Liela Liila Laylah Lailah
Samira: Samira Samiira Sameera Saamira Samirah
Nasrin: Nasrin Nasreen Nasrine Nazreen Nasriin
Rania: Rania Ranya Raniya Raania Raniyah
Suad: Suad Souad Suwad Suaad
Hawa: Hawa Hawaa Hawwa Havva Awa
Ruqiya: Ruqiya Ruqayyah Ruqia Rukia Rugiya Ruqiyah Ruqaiya
Asma: Asma Asmaa Osmaa Asmah
Naima: Naima Naaima Naema Nayima Naiima Naïma
Deeqa: Deeqa Deeqo Diiqo Diiqaa
Asha: Asha Aasha Asho Ashoo
Abdi: Abdi Abdie Abdy Abdye Aabdi
Farah: Farah Faarax Fara Farax Faaraha
Abdullahi: Abdullahi Abdullahii Abdilahi Abdulaahi Abdullehe
Maxamed: Maxamed Maxamad Maxamuud Macamuud
Cali: Cali Caali Calii
Cabdi: Cabdi Cabdie Caabdi Cabdii
Xasan: Xasan Xasaan Xassaan
Guled: Guled Guleed Guuled Guuleed Gooled
Mahad: Mahad Mahaad Mahade Mahaade
Mukhtar: Mukhtar Mukhtaar Muxtaar Muxtar Mokhtar
Sahal: Sahal Sahel Saahil Sahaal
Khadar: Khadar Khaddar Xaadir Xadir Qadar
Jama: Jama Jaama Jamac Jamah
Warsame: Warsame Warsameh Warsama
Harun: Harun Haaruun Haroon Haroun Haruun
Burhan: Burhan Burhaan Burhane Buurhan
Abshir: Abshir Abshiir Absir Aabshir
Shire: Shire Shiire Sheire Shiirey
Faadumo: Faadumo Faduma Fadumo Faaduma Fadumah Faaduuma
Nimco: Nimco Nimcoo Nimko Nimkoo Nimcaan
Luul: Luul Luulo Luula Luullo
Nasteho: Nasteho Nasteeho Nastexo Nasteex
Ifrah: Ifrah Ifrax Ifraha Ifraan
Hamdi: Hamdi Hamdii Hamdiya Hamdiyah
Hibo: Hibo Hiboo Hiibo Hiiboo
Barwaqo: Barwaqo Barwaco Baarwaqo
Shamso: Shamso Shamsiya Shamsu Shamsoo
Bisharo: Bisharo Bishaaro Bishari
Idil: Idil Idiil Idill Iidil
Haile: Haile Hailet Hayle Hayile Hailes Hailemariam Hailom
Tesfaye: Tesfaye Tesfae Tesfai Testfaye Tesfay Tesfaaie
Yohannes: Yohannes Johannes Yohanes Yihannes Yohannis Yoanes
Berhe: Berhe Berhane Berhanu Berhie Berha Berhanie
Ghirmay: Ghirmay Ghirmai Girmay Girmai Ghirma Girma
Tekle: Tekle Teklai Teklay Teklu Teklom Teklehaimanot
Biniam: Biniam Binyam Beniam Binyaam Biniyam Benyam
Kibrom: Kibrom Kibreet Kibrete Kibrat
Amanuel: Amanuel Ammanuel Emanuel Amaneal Amaniel Ammaniel
Tewolde: Tewolde Tewelde Tewoldes Teworld
Gebremichael: Gebremichael Gebremikael Gebre Gebrekidan Gebremariam Gebremedhin
Tsegay: Tsegay Tsegai Tsegae Tsigay Tsegeye
Mehari: Mehari Mhary Mehary Meharee Mihari
Mulugeta: Mulugeta Mulugete Mulugetta Muluget
Tadesse: Tadesse Tadese Tadess
Girma: Girma Girmaa Giirma Girmaye
Ermias: Ermias Ermiyas Ermyias Irmias
Tigist: Tigist Tigisit Tigisti Tigis
Hiwet: Hiwet Hewet Hiwot Hiwit Hewot
Selam: Selam Selem Sellam Selame Silem
Hirut: Hirut Hiirut Hiruut
Lemlem: Lemlem Lemlam Limlim
Tsehay: Tsehay Tsehai Tsehaye Tsehey Tsihai
Azmera: Azmera Azmeera Azmara Azmere
Saba: Saba Saaba Sabah Sheba Saab
Liya: Liya Liiya Liyaa Leia Lia
Mekdes: Mekdes Mekdess Mekdees Mekdese
Yordanos: Yordanos Yordanus Yordaanos Yordanes
Selamawit: Selamawit Selamaweet Selamawit
Almaz: Almaz Almaaz Almas Almazz
Hanna: Hanna Hannah Hana Hanaa Hanah
Imran: Imran Imraan Imren Emraan Emran Emren
Usman: Usman Uthman Othman Usmaan Ousman
Kamran: Kamran Kamraan Kamren Camran
Bilal: Bilal Bilaal Billal Bilel Billaal Bilall
Hamza: Hamza Hamzah Hamzaa Hamzeh Hamze
Waseem: Waseem Wasim Wasseem Wasime
Zubair: Zubair Zubayr Zubaer Zubear
Faisal: Faisal Faysal Faisel Faysaal Faysel Faizal
Adnan: Adnan Adnaan Ednan Adnane
Salman: Salman Salmaan Selman Salmen
Rizwan: Rizwan Rizvaan Rizwaan Ridwan
Shoaib: Shoaib Shuaib Shuayb Shoaab Shoeb
Aamir: Aamir Amir Ameer Aameer Amer
Asif: Asif Assif Aasif Aseef
Kashif: Kashif Kaashif Kashaf Kaashaf
Pervez: Pervez Perwez Parwez Parvez Perviz
Zara: Zara Zarah Zaara Zaraa Zahara Zahrah
Sana: Sana Sanaa Sanah Sanna Saana
Nadia: Nadia Nadya Nadiah Nadiyah Nadea
Hina: Hina Heena Hiina Henaa Hinna
Shaista: Shaista Shaeesta Shaysta Shaesta Shaistah
Bushra: Bushra Bushrah Boshra Bushira
Rabia: Rabia Rabiah Rabiya Raabiya Rabeea Rabea
Saima: Saima Saema Saeema Saaimah Saaema
Uzma: Uzma Uzmah Oozma Uzmaa
Rukhsar: Rukhsar Rukhsaar Ruxsar Ruksar Rokhsar
Mehwish: Mehwish Mewish Mehvish Mehwishe
Oleksandr: Oleksandr Olexandr Alexandr Alexander Aleksander Oleksander Sashko Sasha Sacha Olexander
Mykola: Mykola Mikola Nikolai Nikolay Kolya
Dmytro: Dmytro Dmitro Dmitri Dmitry Dmytry Dymtro
Andriy: Andriy Andrii Andrij Andrei Andrey Andri
Serhiy: Serhiy Serhii Serhij Sergiy Sergii Sergi Sergei Serge
Vasyl: Vasyl Vasil Vasyle Vasili Vasily Bazyl
Pavlo: Pavlo Pavol Pavel Pavio
Taras: Taras Tarase Taraz
Bohdan: Bohdan Bogdan Boghdan
Ivan: Ivan Iwan Evan Ivann Ivane
Mykhailo: Mykhailo Mychailo Mikhaylo Mikhail Mikhailo Mykhaylo
Volodymyr: Volodymyr Volodimir Vladimir Vladymyr Volodymir
Yaroslav: Yaroslav Iaroslav
Oleh: Oleh Oleg Olegh
Ruslan: Ruslan Ruslen Ruslin Rouslan
Yuriy: Yuriy Yurii Jurij Yuri Georgiy Georgii
Artem: Artem Artyom Artiem Artjom
Vitaliy: Vitaliy Vitalii Vitalij Vitali
Kyrylo: Kyrylo Kyryllo Kyril Cyril Kiril Kiro
Maksym: Maksym Maksim Maxim Maksyme Maxime
Olena: Olena Yelena Elena Alena Olenka
Natalia: Natalia Nataliya Natalija Natalya Natasha Natacha
Iryna: Iryna Irina Irene Yryna
Oksana: Oksana Oxana Oksanna Oxanna Oksane
Halyna: Halyna Galyna Galina Halina Haline Galine
Svitlana: Svitlana Svitlanna Svetlana Svitlane Svitlena
Tetiana: Tetiana Tatiana Tatianna Tetyana Tatyana Tanya
Yuliia: Yuliia Yulia Julia Yuliya Yulija
Anastasiia: Anastasiia Anastasia Anastasiya Anastassia Nastia Nastya
Mariia: Mariia Maria Mariya Marija Marie Maryia
Darya: Darya Daria Dariya Darija Daryia
Kateryna: Kateryna Katerina Katarina Katrina Katryn Katia Katja
Viktoriia: Viktoriia Victoria Viktoria Viktoriya Viktorija Vika
Sofiia: Sofiia Sofia Sophia Sofiya Sofija Sophie
Yana: Yana Jana Yanna Janna Yaana
Alina: Alina Aline Alyna Alyina
Nadiia: Nadiia Nadia Nadiya Nadijia
Larysa: Larysa Larissa Larisa Laryssa Larise
Hossain: Hossain Hossein Hussain Husain Hossaine Hussaine
Islam: Islam Islaam Islem Eslam Islame
Chowdhury: Chowdhury Choudhoury Choudhury Chaudhury Chaudhry Chowdhery
Rahman: Rahman Rahmann Rahmaan Rehman Rehmaan Rehmann
Kabir: Kabir Kabeer Kabiir Kabire
Faruk: Faruk Farooq Farouk Farouq Faruque
Shamim: Shamim Shameem Shamiim Shamime
Sabbir: Sabbir Sabir Shabir Saabir Saabiir
Mamun: Mamun Mamuun Mamoun Mamune
Fatema: Fatema Fatima Fathema Fatimah Fateema
Roshni: Roshni Rosni Rosshni Rossni
Nargis: Nargis Narges Nargees Naargis
Sharmin: Sharmin Sharmeen Sharmine Shaarmeen
Tania: Tania Tanya Taniya Taania Taniyaa
Bristy: Bristy Brishti Bristee Brishtee
Shefali: Shefali Shephali Sheefalee Shefaalee"""
