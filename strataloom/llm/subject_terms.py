"""Subject terms: fixed values. General vocabulary of each subject in four languages, two lists a subject: terms of its own, and words that other subjects share; without accents, lower case."""

STRONG: dict[str, str] = {
    "databases": """primary key, foreign key, sort key, composite key, surrogate key, unique constraint, missing index, secondary index, covering index, query planner, query plan, query optimizer, slow query, full scan, sequential scan, sql, nosql, join order,
        inner join, outer join, left join, hash join, row count, read replica, replica, replication lag, transaction log, write ahead log, open transaction, isolation level, deadlock, table lock, row lock, vacuum, write amplification, partition pruning, sharding,
        materialised view, materialized view, schema migration, column type, backfill, stored procedure, trigger function, database, postgres, mysql, sqlite, clickhouse, oracle, mongodb, redis, tablespace, normal form, b tree, upsert, rollback segment, data warehouse, connection pool,
        fremdschlussel, primarschlussel, abfrageplan, spaltentyp, tabellensperre, lesekopie, datenbank, langsame abfrage, transaktion, replikation,
        cle etrangere, cle primaire, plan de requete, type de colonne, verrou de table, transaction ouverte, index manquant, base de donnees, requete lente,
        clave foranea, clave primaria, plan de consulta, tipo de columna, bloqueo de tabla, indice que falta, base de datos, consulta lenta, migracion del esquema""",
    "education": """teacher, pupil, school, classroom, lesson, homework, exam, examination, university, college, seminar, lecture, lecturer, semester, quiz, tutoring, tutor, enrolment, enrollment, reading list, grade book, gradebook, report card, timetable,
        curriculum, syllabus, student, tuition, kindergarten, textbook, diploma, degree course, campus, scholarship, pedagogy, coursework, school year, dissertation,
        lehrkraft, lehrer, lehrerin, schulklasse, schule, schuler, hausaufgabe, notenbuch, stundenplan, prufung, unterricht, universitat, klausur, zeugnis, vorlesung,
        enseignante, enseignant, salle de classe, carnet de notes, devoirs, emploi du temps, examen, ecole, eleve, professeur, universite, lycee,
        profesora, profesor, aula, escuela, alumno, libro de notas, tarea, deberes, horario escolar, universidad, asignatura""",
    "finance": """invoice, refund, credit note, credit card, debit card, card charge, discount code, coupon, tax rate, sales tax, vat, currency, exchange rate, price, pricing, overdue balance, payment, payment method, subscription plan, subscription, spending cap, revenue report, revenue,
        euros, dollars, money, ledger, bookkeeping, payroll, accounting, accountant, dunning, bank account, bank transfer, interest rate, budget, mortgage, loan, shareholder, dividend, balance sheet, cash flow, profit, stock market, audit of accounts, expense,
        rechnung, gutschrift, ruckerstattung, monatspreis, steuersatz, zahlungsart, zahlung, mahnung, umsatz, mehrwertsteuer, wahrung, abonnement, buchhaltung, bankkonto,
        facture, remboursement, abonnement mensuel, moyen de paiement, paiement, taux de taxe, avoir, tva, devise, tarif, prix mensuel, comptabilite,
        factura, reembolso, nota de credito, precio mensual, forma de pago, tipo de impuesto, iva, moneda, suscripcion, contabilidad""",
    "frontend": """dropdown, dropdown menu, css, css variable, stylesheet, hover state, hover, flexbox, flex layout, page header, button style, sidebar, icon set, modal dialog, popup, tooltip, scroll position, key handler, keyboard focus, web page, landing page,
        form input, component tree, render cycle, rerender, drag handle, chart legend, dark theme, dark mode, palette, spinner, viewport, html, browser, dom, react, react component, font size, placeholder text, breadcrumb, navbar, responsive layout, web design, javascript framework, typography,
        schaltflache, auswahlmenu, seitenleiste, tastaturfokus, eingabefeld, schriftgrosse, dunkles design, bildlauf, benutzeroberflache,
        menu deroulant, barre laterale, bouton, champ de saisie, info bulle, mise en page, theme sombre, feuille de style, navigateur,
        menu desplegable, barra lateral, boton, campo de texto, diseno de la pagina, tema oscuro, hoja de estilo, navegador""",
    "health": """patient, nurse, doctor, hospital, clinic, clinical, hospital ward, surgery, surgeon, blood, blood pressure, vaccination, vaccine, prescription, dosage, dose, symptom, therapy, triage, care pathway, care plan, lab result, allergies, allergy,
        diagnosis, medication, pharmacy, medical, medicine, physician, illness, disease, infection, fever, chronic, cancer, diabetes, ambulance, midwife, wellbeing, mental health, dental,
        patientenakte, impfliste, impfung, laborbefund, therapieplan, blutdruck, blutdruckwert, dosierung, krankenhaus, arzt, arztin, pflege, krankheit,
        dossier patient, ordonnance, posologie, plan de soins, tension arterielle, resultat de laboratoire, hopital, medecin, vaccin, maladie,
        historia clinica, receta medica, dosis, plan de terapia, presion arterial, resultado de laboratorio, paciente, medico, vacuna, enfermedad""",
    "law": """court order, court, judge, lawyer, solicitor, regulator, regulation, licence clause, license clause, licence, liability, clause, consent, cookie consent, consent banner, terms of service, privacy notice, privacy policy, legal hold, legal, lawsuit, plaintiff, defendant,
        right to erasure, erasure, data processing agreement, processing agreement, subprocessor, retention duty, retention period, copyright, compliance, export regulation, annex, gdpr, statute, legislation, attorney, trademark, patent, litigation, verdict, appeal court, data protection, contract law, parliament act,
        einwilligung, lizenzklausel, gerichtsbeschluss, aufbewahrungspflicht, auftragsverarbeitung, datenschutzhinweis, datenschutz, anwalt, gericht, haftung, gesetz, klage,
        consentement, clause de licence, decision de justice, mentions legales, droit a l effacement, obligation de conservation, avocat, tribunal, reglement, loi,
        consentimiento, clausula de licencia, orden judicial, aviso legal, derecho de supresion, deber de conservacion, abogado, reglamento, demanda judicial""",
    "machine_learning": """embedding, embedding vector, feature vector, classifier, training run, training set, training data, learning rate, loss curve, loss function, gradient, gradient descent, attention layer, model weights, fine tuned, fine tuning, label noise, mislabelled,
        evaluation set, validation set, prompt template, token budget, hallucinated, hallucination, inference, overfit, overfitting, epoch, gpu, neural, neural network, deep learning, machine learning, language model, llm, transformer, random forest, decision tree, clustering algorithm,
        test set, hyperparameter, backpropagation, reinforcement learning, convolution, supervised, unsupervised, recommender,
        trainingslauf, lernrate, verlustkurve, klassifikator, modellgewichte, einbettungsvektor, maschinelles lernen, neuronales netz,
        entrainement du modele, taux d apprentissage, classifieur, poids du modele, vecteur d embedding, jeu d evaluation, apprentissage automatique, reseau de neurones,
        entrenamiento del modelo, tasa de aprendizaje, clasificador, pesos del modelo, vector de embedding, conjunto de evaluacion, aprendizaje automatico, red neuronal""",
    "mobile": """android, ios, iphone, ipad, app store, play store, store review, app crash, swipe, screen rotation, push notification, background fetch, deep link, offline mode, tablet, battery, battery drain, touch target,
        phone, handset, simulator, emulator, mobile app, mobile device, apk, touchscreen, smartphone, home screen, gesture, sim card, bluetooth, device permission, swiftui, kotlin,
        app absturz, android version, akkuverbrauch, bildschirmdrehung, push nachricht, wischgeste, handy, mobilgerat,
        plantage de l appli, version android, batterie du telephone, rotation de l ecran, notification push, geste de balayage, tablette, telephone portable,
        cierre de la app, version de android, bateria del telefono, giro de pantalla, notificacion push, gesto tactil, tableta, movil""",
    "operations": """autoscaler, autoscaling, load balancer, canary, canary release, rollout, rollback, deploy pipeline, deployment, container image, container, docker, pod restart, pods, kubernetes, node pool, cluster upgrade, cluster, health probe,
        alert rule, alerting, on call, pager, outage, dns, backup job, nightly backup, backup, disk pressure, memory limit, log volume, incident, postmortem,
        runbook, uptime, downtime, terraform, helm chart, latency budget, failover, service level, monitoring, observability, infrastructure, provisioning, blue green, data center, server rack,
        lastverteiler, bereitschaftsdienst, sicherungslauf, speichergrenze, container abbild, ausrollen, ausfall des clusters, ausfall, datensicherung,
        repartiteur de charge, astreinte, image du conteneur, limite de memoire, panne du cluster, deploiement, sauvegarde, supervision,
        balanceador de carga, guardia, imagen del contenedor, limite de memoria, caida del cluster, despliegue, copia de seguridad""",
    "security": """access token, csrf, csrf cookie, cipher, two factor, brute force, password, login attempt, permission check, role grant, privilege escalation, single sign on, session hijack, secret rotation, key rotation, signed webhook, audit trail,
        vulnerability, cve, revoked, encryption, encrypted, phishing, xss, cross site scripting, sql injection, malware, ransomware, firewall, exploit, oauth, authentication, authorization, attacker, hacker, intrusion, penetration test, certificate, data breach,
        passwort, anmeldeversuch, sicherheitslucke, schlusselwechsel, zwei faktor, zugriffsrecht, verschlusselung, angreifer,
        mot de passe, tentative de connexion, faille de securite, jeton d acces, double authentification, droit d acces, chiffrement,
        contrasena, intento de acceso, fallo de seguridad, token de acceso, doble factor, permiso de acceso, cifrado""",
    "sport": """coach, referee, tournament, league table, league, match score, halftime, penalty shootout, shootout, goalkeeper, goal keeper, away game, home game, season ticket, relay team, marathon, lap time, runner, final whistle,
        standings, sports club, extra time, training session, stadium, championship, athlete, football, soccer, basketball, tennis, rugby, cricket, cyclist, swimmer, olympic, medal, scored, quarter final, semi final, midfielder, striker, world cup,
        trainerin, auswartsspiel, torhuterin, torwart, tabellenplatz, elfmeter, rundenzeit, verein, halbzeit, turnier, staffel, liga, dauerkarte, meisterschaft, fussball,
        classement du championnat, match a l exterieur, score du match, mi temps, temps au tour, gardienne, gardien de but, entraineuse, entraineur, tirs au but, tournoi, championnat, arbitre,
        partido fuera, partido, tanda de penaltis, portera, portero, entrenadora, entrenador, tiempo por vuelta, torneo, descanso, campeonato, clasificacion de la liga, marcador""",
    "statistics": """confidence interval, p value, significance, statistically significant, standard error, standard deviation, sample size, bootstrap sample, effect size, control group, hypothesis, null hypothesis, variance, regression line, linear regression, outlier, percentile, median, quantile,
        prior distribution, posterior, long tail, normal distribution, uplift, correlated, correlation, a b test, bayesian, anova, random sample, census, survey data, statistic, margin of error, chi squared, t test, confounder, histogram,
        konfidenzintervall, kontrollgruppe, standardfehler, stichprobe, varianz, signifikanz, mittelwert, verteilung, statistik,
        intervalle de confiance, groupe temoin, erreur type, echantillon, ecart median, ecart type, moyenne, statistique,
        intervalo de confianza, grupo de control, error estandar, muestra, mediana, varianza, media aritmetica, estadistica""",
}

SHARED: dict[str, str] = {
    "databases": "table, index, join, query, rows, column, key, session, select, partition, schema, planner, migration, storage",
    "education": "class, course, test, marks, training, grade, learning",
    "finance": "bill, balance, card, charge, contract, plan, cost, billing, account",
    "frontend": "theme, menu, button, header, legend, table, component, layout, form, list, session, key, label, page, screen",
    "health": "record, dashboard, chart, test, care, treatment",
    "law": "contract, notice, audit, banner, hold, agreement, act, rule, policy",
    "machine_learning": "model, training, label, prompt, score, feature, test, vector, tokens, batches, learning, prediction",
    "mobile": "app, build, screen, touch, launch, session, device",
    "operations": "image, service, node, record, deploy, pressure, probe, restart, server, release",
    "security": "key, session, token, secret, role, access, permission, webhook, test, account, protection",
    "sport": "match, game, score, team, season, table, training, lap, class, goal, player, club",
    "statistics": "sample, distribution, bounds, experiment, test, score, model, session, mean, estimate",
}
